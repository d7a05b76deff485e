"""Column-expression helpers (built-in Spark functions only)."""

from carepath.functions.scalar import (
    array_to_string,
    clamp,
    clamped_probability,
    count_vectorizer_tokens,
    nan_to,
    percent,
    relu,
    rounded_array_string,
    sigmoid,
    word_tokens,
)
from carepath.functions.vector import (
    concat_vectors,
    dot,
    gate,
    linear1,
    lit_vector,
    layer_norm,
    vector_mean,
    weighted_sum,
)

__all__ = [
    "array_to_string",
    "clamp",
    "clamped_probability",
    "concat_vectors",
    "count_vectorizer_tokens",
    "dot",
    "gate",
    "linear1",
    "lit_vector",
    "nan_to",
    "layer_norm",
    "vector_mean",
    "percent",
    "relu",
    "rounded_array_string",
    "sigmoid",
    "weighted_sum",
    "word_tokens",
]
