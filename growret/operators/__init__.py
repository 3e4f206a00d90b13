"""DataFrame operators: heatmap, bursts, timing, exact group quantiles."""
