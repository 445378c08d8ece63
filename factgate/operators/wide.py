"""Attribute-value rows into wide tables.

Cells are typed and pre-aggregated per (entity, attribute) before any shuffle leaves a map task, so an entity or an
attribute that holds a third of all rows sends one row per map task. Cells are then sorted by entity, their attributes
encoded as column indices, and streamed into sparse columnar batch builders (typed buffers with validity masks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgate.functions.dates import MONTH_RE, existing_date, month_number
from factgate.functions.text import BLANK, name_key, squeeze, trim_blanks
from factgate.tables import small_rows

#: A wide table has at most this many columns; the catalogue must fit the driver.
MAX_COLUMNS = 10_000
# Spellings of no value, and of the two truth values.
NO_VALUE = ("", "null", "none", "n/a")
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

_NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?"
_SEP = rf"(?:{BLANK}|[-,.])+"
_SPARK = {"int": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "string": T.StringType()}
_ISSUES = {1: "unreadable", 2: "conflict"}


def _date_of(v: Column) -> Column:
    iso = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    dmy = rf"(?i)^(\d{{1,2}}){_SEP}({MONTH_RE}){_SEP}(\d{{4}})$"
    mdy = rf"(?i)^({MONTH_RE}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}})$"

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(v, p, i)

    return (
        F.when(v.rlike(iso), existing_date(g(iso, 1), g(iso, 3), g(iso, 4)))
        .when(v.rlike(us), existing_date(g(us, 3), g(us, 1), g(us, 2)))
        .when(v.rlike(dmy), existing_date(g(dmy, 3), month_number(g(dmy, 2)), g(dmy, 1)))
        .when(v.rlike(mdy), existing_date(g(mdy, 3), month_number(g(mdy, 1)), g(mdy, 2)))
    )


def typed_cells(triples: DataFrame, catalog: list[tuple[str, str, str | None]]) -> DataFrame:
    """One row per (entity, attribute) with the count of values, of readable ones and their least and greatest."""
    spark = triples.sparkSession
    columns = spark.createDataFrame(
        [(n, i, t, (u or "").lower()) for i, (n, t, u) in enumerate(catalog)] or [("", -1, "string", "")],
        "attribute string, col int, kind string, unit string",
    )
    rows = triples.select(name_key(F.col("entity")).alias("entity"), name_key(F.col("attribute")).alias("attribute"), trim_blanks(F.col("value")).alias("v"))
    rows = rows.filter(F.coalesce(F.col("entity"), F.lit("")) != "").filter(F.coalesce(F.col("attribute"), F.lit("")) != "")
    rows = rows.join(F.broadcast(columns), "attribute", "left")
    kind, v, low = F.coalesce(F.col("kind"), F.lit("string")), F.col("v"), F.lower(F.col("v"))
    rows = rows.withColumn("has", v.isNotNull() & ~low.isin(*NO_VALUE))
    head = F.regexp_extract(v, _NUMBER, 0)
    rest = F.lower(trim_blanks(F.substring(v, F.length(head) + 1, F.length(v))))
    plain = F.when((head != "") & ((rest == "") | (rest == F.col("unit"))), F.replace(head, F.lit(","), F.lit("")))
    dec, dbl = plain.try_cast("decimal(38,18)"), plain.try_cast("double")
    whole = F.when((dec == F.floor(dec)) & ((F.abs(dbl) >= 1) | (dbl == 0)), dec.try_cast("bigint"))
    truth = F.when(low.isin(*TRUE_WORDS), F.lit(1)).when(low.isin(*FALSE_WORDS), F.lit(0))
    finite = F.when(~F.isnan(dbl) & (F.abs(dbl) < float("inf")), dbl + F.lit(0.0))
    rows = rows.select(
        "entity", "attribute", F.coalesce(F.col("col"), F.lit(-1)).alias("col"), "has",
        F.when(F.col("has"), F.when(kind == "int", whole).when(kind == "boolean", truth.cast("bigint")).when(kind == "date", F.unix_date(_date_of(v)).cast("bigint"))).alias("l"),
        F.when(F.col("has") & (kind == "float"), finite).alias("d"),
        F.when(F.col("has") & (kind == "string"), F.lower(squeeze(v))).alias("s"),
        F.when(F.col("has") & (kind == "string"), v).alias("raw"),
    )
    cells = rows.groupBy("entity", "attribute", "col").agg(
        F.count_if("has").alias("n"),
        F.count_if(F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("s")).isNotNull()).alias("readable"),
        *(f(x).alias(f"{x}_{n}") for x in ("l", "d", "s") for n, f in (("lo", F.min), ("hi", F.max))),
        F.min("raw").alias("raw"),
    )
    differ = (F.col("l_lo") < F.col("l_hi")) | (F.col("d_lo") < F.col("d_hi")) | (F.col("s_lo") < F.col("s_hi"))
    issue = F.when(F.col("col") < 0, 0).when((F.col("n") > 0) & (F.col("readable") == 0), 1).when(F.coalesce(differ, F.lit(False)), 2).otherwise(0)
    return cells.select("entity", "attribute", "col", issue.cast("int").alias("issue"), F.col("l_lo").alias("l"), F.col("d_lo").alias("d"), F.col("raw").alias("s"), (F.col("readable") > 0).alias("readable"))


def column_names(catalog: list[tuple[str, str, str | None]]) -> list[str]:
    """Output column of each attribute; one named like a fixed column gets the suffix _value."""
    return [f"{n}_value" if n in ("entity", "others", "issues") else n for n, _, _ in catalog]


def _builder(names: list[str], kinds: list[str], attributes: list[str]):
    """Streams sorted cells into wide record batches; holds the cells of one batch and of one open entity."""
    arrow = {"int": pa.int64(), "float": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}
    issue_type = pa.struct([("attribute", pa.string()), ("issue", pa.string())])

    def emit(t: pa.Table) -> pa.RecordBatch:
        ent = t.column("entity").combine_chunks()
        new = np.r_[True, pc.not_equal(ent[1:], ent[:-1]).to_numpy(zero_copy_only=False)] if len(ent) > 1 else np.array([True])
        row = np.cumsum(new) - 1
        n = int(row[-1]) + 1
        col, issue = t.column("col").to_numpy(), t.column("issue").to_numpy()
        fills = t.column("readable").to_numpy(zero_copy_only=False).astype(bool) & (issue == 0)
        order = np.argsort(col, kind="stable")
        starts = np.searchsorted(col[order], np.arange(-1, len(names) + 1))
        out = [pc.take(ent, pa.array(np.flatnonzero(new)))]
        wide, dbl, text = t.column("l"), t.column("d"), t.column("s").combine_chunks()
        longs = pc.fill_null(wide, 0).to_numpy()
        dbls = pc.fill_null(dbl, 0.0).to_numpy()
        for c, kind in enumerate(kinds):
            at = order[starts[c + 1] : starts[c + 2]]
            at = at[fills[at]]
            invalid = np.ones(n, bool)
            invalid[row[at]] = False
            if kind == "string":
                idx = np.zeros(n, np.int64)
                idx[row[at]] = at
                out.append(pc.take(text, pa.array(idx, mask=invalid)))
                continue
            buf = np.zeros(n, np.float64 if kind == "float" else np.int64)
            buf[row[at]] = (dbls if kind == "float" else longs)[at]
            if kind == "boolean":
                buf = buf.astype(bool)
            elif kind == "date":
                buf = buf.astype(np.int32)
            out.append(pa.array(buf, mask=invalid).cast(arrow[kind]) if kind != "date" else pa.array(buf, pa.int32(), mask=invalid).cast(pa.date32()))
        loose = np.flatnonzero((col < 0) & fills)
        off = np.searchsorted(row[loose], np.arange(n + 1)).astype(np.int32)
        keys, items = (pc.take(x, pa.array(loose)) for x in (t.column("attribute").combine_chunks(), text))
        out.append(pa.MapArray.from_arrays(pa.array(off), keys, items))
        bad = np.flatnonzero(issue > 0)
        off = np.searchsorted(row[bad], np.arange(n + 1)).astype(np.int32)
        said = pa.StructArray.from_arrays([pa.array([attributes[col[i]] for i in bad], pa.string()), pa.array([_ISSUES[issue[i]] for i in bad], pa.string())], fields=list(issue_type))
        out.append(pa.ListArray.from_arrays(pa.array(off), said))
        return pa.RecordBatch.from_arrays(out, names=["entity", *names, "others", "issues"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            ent = t.column("entity")
            last = pc.equal(ent, ent[-1]).to_numpy(zero_copy_only=False)
            keep = int(np.argmax(last))  # sorted by entity: the open one is a suffix
            if keep:
                yield emit(t.slice(0, keep).combine_chunks())
            held = t.slice(keep)
        if held is not None:
            yield emit(held.combine_chunks())

    return run


def to_wide(triples: DataFrame, attribute_catalog: DataFrame) -> DataFrame:
    """One row per entity, one typed column per catalogue attribute, `others` and `issues`.

    triples: entity, attribute, value (strings; any further column is ignored). attribute_catalog: attribute,
    value_type, unit_name. Names compare by name_key. Int and float cells become bigint and double; an int beyond 64
    bits or a float beyond double counts as unreadable. A cell whose values differ, or of which none is readable, is null
    and named in `issues` (attribute, issue); a cell without any value is null. Attributes outside the catalogue go to
    the map `others` as text. Rows without an entity or attribute name describe no cell and are left out; an entity
    whose cells are all empty still has its row. An empty input gives an empty table with all columns.
    """
    known: dict[str, tuple[str, str, str | None]] = {}
    rows = attribute_catalog.select(name_key(F.col("attribute")).alias("a"), F.lower("value_type").alias("t"), F.lower(trim_blanks(F.col("unit_name"))).alias("u"))
    for r in sorted(small_rows(rows, MAX_COLUMNS, "attribute_catalog"), key=str):
        if r.a:
            known.setdefault(r.a, (r.a, r.t if r.t in _SPARK else "string", r.u))
    catalog = sorted(known.values())
    names = column_names(catalog)
    schema = T.StructType(
        [T.StructField("entity", T.StringType())]
        + [T.StructField(n, _SPARK[k]) for n, (_, k, _) in zip(names, catalog, strict=True)]
        + [T.StructField("others", T.MapType(T.StringType(), T.StringType()))]
        + [T.StructField("issues", T.ArrayType(T.StructType([T.StructField("attribute", T.StringType()), T.StructField("issue", T.StringType())])))]
    )
    cells = typed_cells(triples, catalog).repartition("entity").sortWithinPartitions("entity", "col", "attribute")
    return cells.mapInArrow(_builder(names, [k for _, k, _ in catalog], [a for a, _, _ in catalog]), schema)


def wide_issues(wide: DataFrame) -> DataFrame:
    """Cells of a wide table that have values but not one single readable one."""
    return wide.select("entity", F.explode("issues").alias("i")).select("entity", "i.attribute", "i.issue")
