"""Resampling by a rational factor: a polyphase windowed-sinc filter over blocks with halos.

Output sample n lies at n * down / up of the input. Only `up` positions between input samples occur, so
the filter is a table of `up` phases by taps, made once from the factor; each output is the inner product
of its phase with the input samples around it. A long recording is cut into blocks of outputs, each
with as many input samples beside it as the filter reaches: every block is filtered alone, in a
group of bounded size, and one shuffle deals the samples to their blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side, and output samples of a block.
ZEROS, BLOCK = 16, 16_384


def reach(up: int, down: int, zeros: int = ZEROS) -> int:
    """Input samples on each side of an output that the filter may touch."""
    return math.ceil(zeros * max(1.0, down / up))


def coefficients(up: int, down: int, zeros: int = ZEROS) -> np.ndarray:
    """`up` phases by 2 * reach taps; tap t of a phase weighs the input sample at base + t - reach + 1, where base is the one at or before the output.

    A sinc whose cut-off is the lower of the two rates' halves, under a raised cosine that ends at
    `zeros` crossings; each phase sums to one, so a constant stays what it is.
    """
    width = reach(up, down, zeros)
    share = min(1.0, up / down)
    at = np.arange(-width + 1, width + 1)[None, :] - np.arange(up)[:, None] / up
    h = share * np.sinc(share * at) * np.where(np.abs(at) * share < zeros, 0.5 + 0.5 * np.cos(np.pi * at * share / zeros), 0.0)
    return h / h.sum(axis=1, keepdims=True)


def resample(signal: DataFrame, up: int, down: int, zeros: int = ZEROS, block: int = BLOCK) -> DataFrame:
    """recording_id, sample_idx, value of `signal` (the same columns, sample_idx from 0 without gaps) at up / down times its rate.

    A recording of n samples becomes one of ceil(n * up / down). Beyond its ends there is silence, a null
    value is zero, and a sample_idx that occurs twice counts twice.
    """
    if up < 1 or down < 1:
        raise ValueError("factors are whole numbers from 1")
    common = math.gcd(up, down)
    up, down = up // common, down // common
    table, width = coefficients(up, down, zeros), reach(up, down, zeros)
    # The outputs that an input sample reaches lie at places from (i - width) * up / down to (i + width) * up / down.
    i = F.col("sample_idx")
    first = F.greatest(F.floor((i - width) * up / down / block), F.lit(0).cast("long"))
    last = F.floor(F.floor((i + width) * up / down) / block)
    rows = signal.select("recording_id", i.cast("long").alias("sample_idx"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    dealt = rows.select("recording_id", "sample_idx", "value", F.explode(F.sequence(first, last)).alias("block"))

    def run(key: tuple, samples: pa.Table) -> pa.Table:
        at, x = samples["sample_idx"].to_numpy(), samples["value"].to_numpy()
        begin = key[1].as_py() * block
        n = np.arange(begin, min(begin + block, -(-(int(at.max()) + 1) * up // down)))  # a later block's samples would have been dealt here too, so the last one here tells where outputs end
        low = begin * down // up - width + 1
        held = np.zeros((int(n[-1]) * down // up if len(n) else low) + width - low + 1)
        inside = (at >= low) & (at - low < len(held))
        np.add.at(held, at[inside] - low, x[inside])
        base, phase = n * down // up, n * down % up
        y = np.zeros(len(n))
        for t in range(table.shape[1]):
            y += table[phase, t] * held[base - low - width + 1 + t]
        return pa.table([pa.repeat(key[0], len(n)), pa.array(n), pa.array(y)], ["recording_id", "sample_idx", "value"])

    return dealt.groupBy("recording_id", "block").applyInArrow(run, "recording_id string, sample_idx long, value double")
