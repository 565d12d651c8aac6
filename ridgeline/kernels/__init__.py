"""Ordered numeric kernels: numpy inside, one group per asset outside."""
