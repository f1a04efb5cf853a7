"""Evaluators: the kernel, which runs any query on one value, and the DataFrame compiler."""
