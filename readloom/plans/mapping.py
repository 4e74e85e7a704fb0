"""Read-shaped relations over the driver's tables. Each column's expression is
text that Spark and DuckDB read alike, or a pair of the two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = "cast(event_id as string)"
_HEX = "'0123456789abcdef'"
_LEN = "cast(1 + (event_id * 7) % 96 as int)"

RELATIONS: dict[str, tuple[str, dict]] = {
    "reads": (
        "events",
        {
            "n": "event_id",
            "read_id": f"md5({_K})",
            "channel": "cast(user_id as int)",
            "mux": "cast(event_id % 4 + 1 as int)",
            "read_number": "event_id",
            "run_id": "concat('run', cast(user_id % 3 as string))",
            "flowcell_id": "concat('FC', cast(user_id % 2 as string))",
            "start_time_ms": ("unix_millis(cast(ts as timestamp))", "epoch_us(ts) // 1000"),
            "seq_len": _LEN,
            "seq": f"substring(translate(concat(md5({_K}), md5(concat({_K}, 'x')), md5(concat({_K}, 'y'))), {_HEX}, 'ACGTACGTACGTACGT'), 1, {_LEN})",
            "qstring": f"substring(translate(concat(md5(concat('q', {_K})), md5(concat('r', {_K})), md5(concat('s', {_K}))), {_HEX}, '+-/13579;=?ACEGI'), 1, {_LEN})",
            "num_samples": "cast(4000 + (event_id * 37) % 6000 as bigint)",
            "num_trimmed_samples": "cast(event_id % 300 as bigint)",
            "sample_rate": "cast(4000 as bigint)",
            "model_stride": "cast(6 as bigint)",
            "end_reason": "event_type",
            "value": "value",
            "barcode": "case when event_id % 5 = 0 then 'unclassified' else concat('NB', lpad(cast(event_id % 12 + 1 as string), 2, '0')) end",
            "rg_id": "concat('rg', cast(user_id % 9 + 1 as string))",
        },
    ),
    "records": (
        "lineitem",
        {
            "rec": "l_orderkey * 8 + l_linenumber",
            "qname": "md5(cast(l_orderkey as string))",
            "flag": "cast(case l_returnflag when 'R' then 256 when 'N' then 16 else 0 end + case when l_linestatus = 'F' and l_linenumber > 3 then 2048 else 0 end as int)",
            "rname": "concat('chr', cast(l_suppkey % 5 + 1 as string))",
            "pos": "cast(l_partkey * 10 as bigint)",
            "mapq": "cast(l_linenumber * 9 as int)",
            "cigar": "concat(cast(l_linenumber as string), 'S', cast(10 + cast(floor(l_quantity) as int) as string), 'M', cast(1 + l_linenumber % 3 as string), 'I', cast(5 + cast(floor(l_quantity) as int) as string), 'M', cast(1 + l_partkey % 4 as string), 'D20=2X', cast(1 + l_suppkey % 6 as string), 'S')",
            "nm": "cast(1 + l_linenumber % 3 + 1 + l_partkey % 4 + 2 + l_linenumber % 2 as bigint)",
            "strand": "case when l_returnflag = 'N' then '-' else '+' end",
            "len_q": "cast(l_linenumber + 10 + floor(l_quantity) + 1 + l_linenumber % 3 + 5 + floor(l_quantity) + 22 + 1 + l_suppkey % 6 as bigint)",
            "len_r": "cast(10 + floor(l_quantity) + 5 + floor(l_quantity) + 1 + l_partkey % 4 + 22 as bigint)",
            "rg_id": "concat('rg', cast(l_suppkey % 9 + 1 as string))",
            "hp": "case when l_linenumber % 3 = 0 then null else cast(l_linenumber % 3 as int) end",
        },
    ),
    "groups": (
        "supplier",
        {
            "rg_id": "concat('rg', cast(s_suppkey as string))",
            "rg_flowcell": "concat('FC', cast(s_nationkey % 2 as string))",
            "rg_run": "concat('run', cast(s_nationkey % 3 as string))",
            "rg_model": "case when s_suppkey % 4 = 0 then '' else concat('hac@v', cast(s_nationkey % 3 as string)) end",
            "rg_barcode": "case when s_suppkey % 3 = 0 then 'unclassified' else concat('barcode', lpad(cast(s_suppkey % 90 as string), 2, '0')) end",
            "ds": "concat('runid=', cast(s_nationkey as string), ' basecall_model=hac bad=a=b ', s_name)",
        },
    ),
    "sheet": (
        "nation",
        {
            "row": "cast(n_nationkey as bigint)",
            "flowcell_id": "concat('FC', cast(n_nationkey % 2 as string))",
            "barcode": "concat('NB', lpad(cast(n_nationkey % 12 + 1 as string), 2, '0'))",
            "alias": "n_name",
        },
    ),
    "bed": (
        "lineitem",
        {
            "region": "l_orderkey * 8 + l_linenumber",
            "genome": "concat('chr', cast(l_suppkey % 5 + 1 as string))",
            "start": "cast(l_orderkey * 3 as bigint)",
            "end": "cast(l_orderkey * 3 + l_linenumber as bigint)",
            "bed_strand": "case l_returnflag when 'R' then '+' when 'N' then '-' else '.' end",
        },
    ),
    "hits": (
        "events",
        {
            "hit": "event_id",
            "genome": "concat('chr', cast(user_id % 5 + 1 as string))",
            "start": "cast(event_id * 2 as bigint)",
            "end": "cast(event_id * 2 + 1 + event_id % 9 as bigint)",
            "hit_strand": "case when event_id % 2 = 0 then '+' else '-' end",
        },
    ),
    "variants": (
        "lineitem",
        {
            "var": "l_orderkey * 8 + l_linenumber",
            "seq_id": "concat('chr', cast(l_suppkey % 5 + 1 as string))",
            "pos": "cast(l_orderkey * 3 as bigint)",
            "ref": "case l_linenumber % 4 when 0 then 'A' when 1 then 'CG' when 2 then 'T' else 'GAT' end",
            "alt1": "case l_partkey % 4 when 0 then 'A' when 1 then 'C' when 2 then 'T' else 'GA' end",
            "alt2": "case l_suppkey % 4 when 0 then 'A' when 1 then 'G' when 2 then 'TT' else 'C' end",
            "qual": "l_quantity",
        },
    ),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = RELATIONS[name]
    exprs = [f"{e if isinstance(e, str) else e[0]} as `{c}`" for c, e in columns.items()]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


def cte(name: str) -> str:
    """The relation as a DuckDB common table expression."""
    table, columns = RELATIONS[name]
    cols = ", ".join(f'{e if isinstance(e, str) else e[1]} AS "{c}"' for c, e in columns.items())
    return f"{name} AS (SELECT {cols} FROM {table})"
