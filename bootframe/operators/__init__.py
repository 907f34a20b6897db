"""DataFrame operators: selection, reshape, resampling, statistics, intervals, work slicing."""
