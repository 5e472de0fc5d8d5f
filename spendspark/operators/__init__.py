"""Dataset operators: each is ``f(df, ...) -> DataFrame``."""
