from claimsieve.functions.columns import either, finite, flag, normalised, ratio
from claimsieve.functions.quantiles import exact_quantiles, quantiles, sketch_aggregates, sketch_size

__all__ = ["either", "exact_quantiles", "finite", "flag", "normalised", "quantiles", "ratio", "sketch_aggregates", "sketch_size"]
