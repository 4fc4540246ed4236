"""Column helpers: windows, statistics, distributed ranks, recursive kernels, solvers."""
