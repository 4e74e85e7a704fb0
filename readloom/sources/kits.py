"""Barcode, adapter and primer dimensions: custom arrangements (TOML) and sequences (FASTA) (SRC-25, SRC-26)."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

from readloom.operators.kernels import Kit, Query


def parse_fasta_text(text: str) -> dict[str, tuple[str, str]]:
    """name to (description, sequence)."""
    out = {}
    for record in filter(None, ("\n" + text).split("\n>")):
        head, _, body = record.partition("\n")
        if head.strip():
            name, _, rest = head.strip().lstrip(">").partition(" ")
            out[name] = (rest, "".join(body.split()).upper())
    return out


def parse_kit(toml: str, sequences: str = "") -> Kit:
    """A kit of an arrangement (masks, barcode name pattern and range, scoring) and its
    barcodes' sequences."""
    spec = tomllib.loads(toml)
    arr, score = spec["arrangement"], spec.get("scoring", {})
    seqs = parse_fasta_text(sequences)
    first, last, pattern = arr["first_index"], arr["last_index"], arr["barcode1_pattern"]
    if last < first:
        raise ValueError("the last index comes before the first")
    names = [pattern % i for i in range(first, last + 1)]
    missing = [n for n in names if n not in seqs]
    if missing:
        raise ValueError(f"no sequence for barcodes: {missing}")
    codes = tuple((n, seqs[n][1]) for n in names)
    if len({len(c) for _, c in codes}) != 1:
        raise ValueError("barcodes of one kit must have one length")
    options = {"max_barcode_penalty": "max_penalty", "min_flank_score": "min_flank", "min_barcode_penalty_dist": "min_separation", "min_separation_only_dist": "min_separation_alone", "barcode_end_proximity": "end_proximity", "front_barcode_window": "window", "flank_left_pad": "left_pad", "flank_right_pad": "right_pad", "midstrand_flank_score": "midstrand"}
    both = "barcode2_pattern" in arr or "mask2_front" in arr
    return Kit(arr["name"], arr.get("mask1_front", ""), arr.get("mask1_rear", ""), codes, both, arr.get("mask2_front", ""), arr.get("mask2_rear", ""), **{options[k]: v for k, v in score.items() if k in options})


def parse_primers(fasta: str, kit: str | None = None) -> tuple[list[Query], list[Query]]:
    """Front and rear queries of custom primers: ``type=`` says which end (default both),
    ``kits=`` for which kits."""
    front, rear = [], []
    for name, (text, seq) in parse_fasta_text(fasta).items():
        kits = re.search(r"kits=(\S+)", text)
        if kits and kit is not None and kit not in kits[1].split(","):
            continue
        kind = re.search(r"type=(\S+)", text)
        if not kind or kind[1] in ("front", "adapter", "primer", "both"):
            front.append(Query(f"{name}_FWD", seq))
        if not kind or kind[1] in ("rear", "adapter", "primer", "both"):
            rear.append(Query(f"{name}_REV", seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]))
    return front, rear


def kit_rows(spark: SparkSession, kits: list[Kit]) -> DataFrame:
    """(kit, barcode, seq, front_flank, rear_flank, double_ends): the dimension table."""
    rows = [(k.name, n, c, k.front_flank, k.rear_flank, k.double_ends) for k in kits for n, c in k.barcodes]
    return spark.createDataFrame(rows, "kit string, barcode string, seq string, front_flank string, rear_flank string, double_ends boolean")
