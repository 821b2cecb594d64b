"""Corpus operators for training-data preparation, each a Spark job.

Modules: ``simhash`` (near duplicates), ``chat`` (preference formatting), ``langid``,
``pst`` (language-model scoring), ``zquality`` (quality classifier), ``substring``
(repeated passages), ``decontam`` (benchmark leaks), ``winnow`` (fingerprints),
``warc`` (archives), ``mixing`` (source weights); ``queries`` registers them.
Nothing else in the library imports this subpackage.
"""
