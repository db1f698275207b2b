"""The batch operators that are monotone, over unbounded fragment folders."""
