"""Column functions on sequences, names and texts (STR-*)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC ambiguity codes and the bases they stand for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
UNCLASSIFIED = "unclassified"


def reverse_complement(seq: Column) -> Column:
    """Case is kept; characters other than ACGT stay as they are."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def is_canonical(seq: Column) -> Column:
    return seq.rlike("^[ACGTacgt]+$")


def base_codes(seq: Column) -> Column:
    """A, C, G, T as 0 to 3; other characters as -1."""
    letters = F.filter(F.split(F.upper(seq), ""), lambda b: b != "")
    return F.transform(letters, lambda b: (F.position(b, F.lit("ACGT")) - 1).cast("int"))


def leading_run(seq: Column, char: str) -> Column:
    return F.length(seq) - F.length(F.ltrim(seq, F.lit(char)))


def trailing_run(seq: Column, char: str) -> Column:
    return F.length(seq) - F.length(F.rtrim(seq, F.lit(char)))


def rna_polya_start(seq: Column, window: int = 200, min_run: int = 5) -> Column:
    """0-based start of the last run of at least ``min_run`` A that ends within the
    last ``window`` bases; the length if there is none."""
    n = F.length(seq)
    tail = F.reverse(F.right(seq, F.lit(window)))
    at = F.regexp_instr(tail, F.lit(f"A{{{min_run},}}"))
    run = F.length(F.regexp_extract(tail, f"A{{{min_run},}}", 0))
    return F.when(at > 0, n - (at - 1) - run).otherwise(n).cast("int")


def split_all(text: Column, sep: str) -> Column:
    """Items between separators; the empty text has one empty item."""
    return F.split(text, _quoted(sep), -1)


def split_view(text: Column, sep: str) -> Column:
    """As ``split_all``, but the empty text has no item."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split_all(text, sep))


def _quoted(sep: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in sep)


def number_prefix(text: Column, kind: str = "bigint") -> Column:
    """The number that a text begins with, or null."""
    pattern = r"^-?\d+" if kind in ("int", "bigint") else r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found).try_cast(kind)


def normalize_barcode(name: Column) -> Column:
    """``barcode`` and the last run of digits; ``unclassified`` stays."""
    return F.when(name == UNCLASSIFIED, name).otherwise(F.concat(F.lit("barcode"), F.regexp_extract(name, r"(\d+)\D*$", 1)))


def standard_barcode(kit: Column, name: Column) -> Column:
    return F.concat_ws("_", kit, normalize_barcode(name))


def derive_uuid(parent: Column, what: Column) -> Column:
    """A version 4 style UUID from the first 16 bytes of SHA-256 of both texts."""
    h = F.sha2(F.concat(parent, what), 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sequence_md5(seq: Column) -> Column:
    """M5 of a reference sequence: upper case, printable characters only."""
    return F.md5(F.upper(F.regexp_replace(seq, "[^!-~]", "")))


def motif_hits(seq: Column, motif: str, offset: int = 0) -> Column:
    """0-based positions of all matches, overlapping ones too, plus offset."""
    sets, none = [IUPAC[c] for c in motif.upper()], F.array().cast("array<int>")
    starts = lambda n: F.when(n < len(sets), none).otherwise(F.sequence(F.lit(0), n - len(sets)))
    at = lambda b, i: reduce(and_, [F.get(b, i + j).isin(*s) for j, s in enumerate(sets)])
    # One array of bases, bound to a name: an expression in a lambda is computed for each element.
    found = F.get(F.transform(F.array(F.split(seq, "")), lambda b: F.filter(starts(F.length(seq)), lambda i: at(b, i))), F.lit(0))
    return F.transform(found, lambda i: (i + offset).cast("int"))


def motif_mask(seq: Column, motif: str, scores: Column, least: int) -> Column:
    """How many bases begin a match or have at least that score (one a base; missing ones count as below)."""
    used = F.slice(F.coalesce(scores, F.array().cast("array<int>")), F.lit(1), F.length(seq))
    above = F.filter(F.transform(used, lambda s, i: F.when(s >= least, i)), lambda i: i.isNotNull())
    return F.size(F.array_union(motif_hits(seq, motif), above)).cast("long")


def motif_context(text: Column) -> Column:
    """Per base A, C, G, T the motif and the place of its modified base ``X`` from
    ``a:c:g:t`` text, ``_`` for none."""
    bases = ["A", "C", "G", "T"]
    part = lambda i: F.element_at(F.split(text, ":", -1), i + 1)
    return F.array(*[F.when(part(i) != "_", F.struct(F.lit(b).alias("base"), F.replace(part(i), F.lit("X"), F.lit(b)).alias("motif"), (F.instr(part(i), "X") - 1).alias("offset"))) for i, b in enumerate(bases)])


def valid_mod_code(code: Column) -> Column:
    """One letter or digits only; unlike in some tools the empty text is invalid."""
    return code.rlike("^([A-Za-z]|[0-9]+)$")


def mod_tags(seq: Column, probs: Column, base: str, code: str, threshold: int = 0) -> Column:
    """MM and ML of one modification: how many ``base``s are passed over before each one whose
    probability (0..255, one a base of the read) is above the threshold, and those probabilities."""
    places = F.filter(F.arrays_zip(F.split(seq, "").alias("b"), probs.alias("p")), lambda x: x["b"] == base)
    numbered = F.transform(places, lambda x, i: F.struct(i.alias("i"), x["p"].alias("p")))
    called = F.filter(numbered, lambda x: x["p"] > threshold)
    before = lambda k: F.coalesce(F.get(called, k - 1)["i"], F.lit(-1))
    skips = F.transform(called, lambda x, k: F.concat(F.lit(","), (x["i"] - before(k) - 1).cast("string")))
    mm = F.concat(F.lit(f"{base}+{code}?"), F.array_join(skips, ""), F.lit(";"))
    return F.struct(mm.alias("mm"), F.transform(called, lambda x: x["p"]).alias("ml"))


def parse_region(text: Column) -> Column:
    """name, start (0-based) and end from ``name``, ``name:``, ``name:a-b``, ``name:-b``; null is open."""
    at = F.regexp_extract(text, r"^(.*?)(?::(\d*)(?:-(\d*))?)?$", 2)
    end = F.regexp_extract(text, r"^(.*?)(?::(\d*)(?:-(\d*))?)?$", 3)
    name = F.regexp_extract(text, r"^(.*?)(?::(\d*)(?:-(\d*))?)?$", 1)
    return F.struct(name.alias("name"), F.coalesce(F.when(at != "", at.cast("long") - 1), F.lit(0)).alias("start"), F.when(end != "", end.cast("long")).alias("end"))


def cli_token(command: Column, option: str) -> Column:
    """The argument after an option in a command line, quotes taken off; null without it."""
    found = F.regexp_extract(command, rf"(?:^|\s){_quoted(option)}[\s=]+(\"[^\"]*\"|'[^']*'|\S+)", 1)
    return F.when(found != "", F.regexp_replace(found, "^[\"']|[\"']$", ""))


def trim_flags(adapter: Column, primer: Column, barcode: Column) -> Column:
    """``adapter,primer,barcode`` of what is trimmed, or ``none``."""
    text = F.concat_ws(",", F.when(adapter, F.lit("adapter")), F.when(primer, F.lit("primer")), F.when(barcode, F.lit("barcode")))
    return F.when(text == "", F.lit("none")).otherwise(text)


def trim_mask(text: Column) -> Column:
    """Bits 1, 2, 4 of a trim flags text; null where it mixes ``none`` with others."""
    has = lambda w: F.array_contains(F.split(text, ","), w)
    mask = sum((F.when(has(w), F.lit(b)).otherwise(0) for w, b in (("adapter", 1), ("primer", 2), ("barcode", 4))), F.lit(0))
    return F.when(~(has("none") & (mask > 0)), mask).cast("int")


def model_parts(name: Column) -> Column:
    """variant, version and modifications of ``variant@version,mod@version,...``."""
    parts = F.split(name, ",", -1)
    head = F.element_at(parts, 1)
    one = lambda p: F.struct(F.regexp_extract(p, "^([^@]*)", 1).alias("name"), F.nullif(F.regexp_extract(p, "@(.*)$", 1), F.lit("")).alias("version"))
    return F.struct(one(head)["name"].alias("variant"), one(head)["version"].alias("version"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one).alias("mods"))


def read_group_id(run: Column, model: Column, barcode: Column) -> Column:
    """``run_model[_barcode]``; a read without model belongs to ``unknown``."""
    kept = F.when((barcode != "") & (barcode != UNCLASSIFIED), barcode)
    return F.when(F.coalesce(model, F.lit("")) == "", F.lit("unknown")).otherwise(F.concat_ws("_", run, model, kept))


def undemux_read_group(rg: Column, barcode: Column) -> Column:
    """The read group without its barcode suffix."""
    suffix = F.concat(F.lit("_"), barcode)
    return F.when(F.endswith(rg, suffix), F.substr(rg, F.lit(1), F.length(rg) - F.length(suffix))).otherwise(rg)


def description_field(ds: Column, key: str) -> Column:
    """A value of ``k=v`` tokens; tokens that do not have exactly two parts don't count."""
    parts = F.transform(F.split(ds, " "), lambda t: F.split(t, "=", -1))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) == key))
    return F.get(F.get(good, F.lit(0)), F.lit(1))


def version_parts(version: Column) -> Column:
    """The numbers of a version, so that v10 comes after v9."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: x.cast("int"))
