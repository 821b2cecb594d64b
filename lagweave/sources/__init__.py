"""Where series come from and go to: views, generators, splits, scaling, stored models."""
