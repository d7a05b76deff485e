"""A deterministic text encoder for the encoder hook (``vectors.vectorize_notes_with``): batch inference as a network
does it, with a token axis padded to the longest text of a block, a mask, and pooling over the token axis."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

# Cells (texts x longest text) of one padded block: a batch with one very long text is split, not blown up.
BLOCK_CELLS = 1 << 20

# The encoder's outputs, in order.
ENCODING = ("first", "mean", "largest", "tokens")

_TOKENS = re.compile("[^ \t\n\x0b\x0c\r]+")


def padded_blocks(lengths: Sequence[int], cells: int = BLOCK_CELLS) -> list[np.ndarray]:
    """Places of the texts of each block: texts of like length together, so that padding to the longest of a block
    costs at most ``cells`` (or one text)."""
    order = np.argsort(lengths, kind="stable")
    blocks, start = [], 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * lengths[order[stop]] <= cells:
            stop += 1
        blocks.append(order[start:stop])
        start = stop
    return blocks


def token_lengths(text: str | None) -> np.ndarray:
    """Code points of each token; a null text has none."""
    return np.array([len(t) for t in _TOKENS.findall(text or "")], np.float32)


def make_length_encoder() -> Callable[[np.ndarray], np.ndarray]:
    """The model factory of the hook (called once per worker): every token becomes a state, here its number of code
    points; a text's vector is its first state, the mean and the largest under the mask, and the number of tokens
    (zeros for a text without tokens). Padding never enters a value."""

    def predict(texts: np.ndarray) -> np.ndarray:
        states = [token_lengths(t) for t in texts]
        out = np.zeros((len(states), len(ENCODING)), np.float32)
        for block in padded_blocks([len(s) for s in states]):
            longest = max(1, len(states[block[-1]]))
            padded = np.zeros((len(block), longest), np.float32)
            mask = np.zeros((len(block), longest), bool)
            for row, i in enumerate(block):
                padded[row, : len(states[i])] = states[i]
                mask[row, : len(states[i])] = True
            count = mask.sum(axis=1)
            out[block, 0] = padded[:, 0]
            out[block, 1] = padded.sum(axis=1, dtype=np.float64) / np.maximum(count, 1)
            out[block, 2] = np.where(mask, padded, 0).max(axis=1)
            out[block, 3] = count
        return out

    return predict
