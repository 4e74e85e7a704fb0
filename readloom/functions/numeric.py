"""Column functions on numbers, qualities, times and arrays (MAT-*, TIM-*, AGG-14..17, MOV-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_round_up(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def div_round_closest(a: Column, b: Column) -> Column:
    return F.floor((a + F.floor(b / 2)) / b).cast("long")


def pad_to(a: Column, b: Column) -> Column:
    return (div_round_up(a, b) * b).cast("long")


def phred_scores(qstring: Column) -> Column:
    letters = F.filter(F.split(qstring, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c) - 33)


def mean_qscore(qstring: Column, start: int = 0) -> Column:
    """Mean error probability as Phred, clamped to 1..50; 0 for no bases. A read
    not longer than ``start`` is averaged whole."""
    used = F.when(F.length(qstring) > start, F.substr(qstring, F.lit(start + 1), F.length(qstring))).otherwise(qstring)
    total = F.aggregate(phred_scores(used), F.lit(0.0), lambda acc, q: acc + F.pow(F.lit(10.0), -q / 10.0))
    q = -10.0 * F.log10(total / F.length(used))
    return F.when(F.length(used) > 0, F.greatest(F.lit(1.0), F.least(F.lit(50.0), q))).otherwise(0.0)


def quality_of(p: Column) -> Column:
    """Phred of an error probability: 60 at 0 and below, 0 at 1 and above."""
    return F.when(p <= 0, F.lit(60.0)).when(p >= 1, F.lit(0.0)).otherwise(-10.0 * F.log10(p))


def capped_phred(p: Column, cap: float) -> Column:
    """Phred to three decimals, with the error at least 10**(-cap / 10)."""
    return F.round(-10.0 * F.log10(F.least(F.greatest(p, F.lit(10.0 ** (-cap / 10))), F.lit(1.0))), 3)


def sequence_quality(probabilities: Column) -> Column:
    """Phred (at most 60) that a sequence is wrong whose bases have these probabilities."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + F.log(F.greatest(F.lit(1e-10), p)))
    return F.least(F.lit(60.0), quality_of(1 - F.exp(total)))


def mapq_of(n: Column) -> Column:
    """Mapping quality of one of n equally good places: round(-10 log10(1 - 1/n)), 60 for one."""
    return F.when(n <= 1, F.lit(60)).otherwise(F.round(-10.0 * F.log10(1 - 1 / n))).cast("int")


def gq_margin(gq: Column, thresholds: list[int], margins: list[int]) -> Column:
    """The margin of the last threshold not above gq; the first below all."""
    out = F.lit(margins[0])
    for t, m in zip(thresholds, margins, strict=True):
        out = F.when(gq >= t, F.lit(m)).otherwise(out)
    return out.cast("int")


def lower_median(xs: Column) -> Column:
    s = F.array_sort(xs)
    return F.get(s, F.floor((F.size(xs) - 1) / 2).cast("int"))


def med_mad(xs: Column, factor: float = 1.4826) -> Column:
    """Shift and scale: lower median, and that of absolute differences times factor, plus 1e-9."""
    m = lower_median(xs)
    return F.struct(m.alias("shift"), (lower_median(F.transform(xs, lambda x: F.abs(x - m))) * factor + 1e-9).alias("scale"))


def counting_quantile(xs: Column, q: float) -> Column:
    """The value at sorted place floor(q * (n - 1)), without interpolation."""
    return F.get(F.array_sort(xs), F.floor((F.size(xs) - 1) * F.lit(q)).cast("int"))


def quantile(xs: Column, q: float) -> Column:
    """Linear interpolation between the nearest ranks."""
    s = F.array_sort(xs)
    at = (F.size(xs) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(xs) - 1))
    return a + (b - a) * (at - lo)


def normalise_signal(signal: Column, shift: Column, scale: Column) -> Column:
    return F.transform(signal, lambda x: ((x - shift) / scale).cast("float"))


def moves_to_map(moves: Column, stride: Column, signal_len: Column) -> Column:
    """Signal index of each base, and the signal length at the end."""
    at = F.filter(F.transform(moves, lambda m, i: F.when(m != 0, i * stride)), lambda x: x.isNotNull())
    return F.concat(at, F.array(signal_len.cast("int")))


def move_sums(moves: Column) -> Column:
    """Running number of bases at each move."""
    return F.transform(moves, lambda _, i: F.aggregate(F.slice(moves, 1, i + 1), F.lit(0), lambda a, x: a + x.cast("int")))


def base_to_move(moves: Column, base: Column) -> Column:
    """Place of the move that emits a base (0-based), -1 if there is none."""
    at = F.filter(F.transform(moves, lambda m, i: F.when(m != 0, i)), lambda x: x.isNotNull())
    return F.when(base >= 0, F.coalesce(F.get(at, base.cast("int")), F.lit(-1))).otherwise(-1).cast("int")


def trim_moves(moves: Column, begin: Column, end: Column) -> Column:
    """Moves of the bases begin..end (half-open) and how many places go in front."""
    first, last = base_to_move(moves, begin), base_to_move(moves, end)
    stop = F.when(last < 0, F.size(moves)).otherwise(last)
    return F.struct(first.alias("front"), F.slice(moves, first + 1, F.greatest(stop - first, F.lit(0))).alias("moves"))


def iso_utc(ms: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSS+00:00`` of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def run_stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd_HHmm")


def iso_seconds(s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_to_ms(text: Column) -> Column:
    """Epoch milliseconds of ISO text with an offset or Z; 0 where it can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0)).cast("long")


def argmax_index(xs: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def run_lengths(xs: Column) -> Column:
    """(start, end, value) of runs of equal values in an array."""
    n = F.size(xs)
    heads = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (F.get(xs, i) != F.get(xs, i - 1))))
    ends = lambda k: F.coalesce(F.get(heads, k + 1), n)
    return F.transform(heads, lambda i, k: F.struct(i.alias("start"), ends(k).alias("end"), F.get(xs, i).alias("value")))
