"""Schema snapshots, their hashes, and what changed between two of them.

Inputs are the flat snapshot tables (one row per column, one row per table);
``prev`` and ``curr`` may hold many sources at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TABLE = ("source_id", "table_name")
SCAN_TRIGGERS = ("new_table", "new_column", "type_change", "initial_scan", "row_count_spike")
SCOPE_TYPES = ("new_table", "new_column", "type_change")


def _escaped(c: Column) -> Column:
    """One character as it stands inside a JSON string of ASCII characters."""
    code = F.ascii(c)
    unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
    high, low = F.lit(0xD800) + F.floor((code - 0x10000) / 1024), F.lit(0xDC00) + (code - 0x10000) % 1024
    short = {"\"": "\\\"", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    out = F.when(c == "", "")
    for char, text in short.items():
        out = out.when(c == char, text)
    return out.when(code < 0x20, unit(code)).when(code < 0x80, c).when(code < 0x10000, unit(code)).otherwise(
        F.concat(unit(high.cast("long")), unit(low.cast("long"))))


def _json_string(value: Column) -> Column:
    """A JSON string literal the way the canonical form writes it, non-ASCII characters escaped; null as ``null``."""
    plain = value.rlike(r'^[ !#-\[\]-~]*$')
    text = F.when(plain, value).otherwise(F.array_join(F.transform(F.split(value, ""), _escaped), ""))
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def _hash_of(entries: Column, table: Column) -> Column:
    """Sixteen hex digits over the columns of one table, given as structs that begin with the name.

    The canonical text has sorted keys and a space after ``:`` and ``,``; the columns are sorted by name.
    """
    body = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(
        F.lit('{"name": '), _json_string(e["name"]), F.lit(', "nullable": '), F.coalesce(e["nullable"].cast("string"), F.lit("null")),
        F.lit(', "type": '), _json_string(e["type"]), F.lit("}"))), ", ")
    return F.substring(F.sha2(F.concat(F.lit('{"columns": ['), body, F.lit('], "name": '), _json_string(table), F.lit("}")), 256), 1, 16)


def _hash_entry(kind: str, nullable: str) -> Column:
    return F.struct(F.col("column_name").alias("name"), F.col(kind).alias("type"), F.col(nullable).alias("nullable"))


def table_hashes(columns: DataFrame) -> DataFrame:
    """Hash and column count per table; the columns of one table, which every catalog bounds, are gathered."""
    entries = columns.groupBy(*TABLE).agg(
        F.collect_list(_hash_entry("data_type", "is_nullable")).alias("_e"), F.count(F.lit(1)).alias("column_count"))
    return entries.select(*TABLE, "column_count", _hash_of(F.col("_e"), F.col("table_name")).alias("table_hash"))


def source_hashes(columns: DataFrame) -> DataFrame:
    """Snapshot summary per source: hash of the sorted table hashes, table and column counts."""
    return table_hashes(columns).groupBy("source_id").agg(
        F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("table_hash")), "|"), 256), 1, 24)
        .alias("schema_hash"),
        F.count(F.lit(1)).alias("table_count"), F.sum("column_count").alias("column_count"))


CHANGE = ("struct<change_type:string,entity_type:string,entity_name:string,severity:string,change_detail:map<string,string>>")


def _change(kind: str, entity_type: str, entity: Column, severity: str, detail: dict) -> Column:
    """A change record; ``detail`` becomes a string map."""
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(kind).alias("change_type"), F.lit(entity_type).alias("entity_type"), entity.alias("entity_name"),
                    F.lit(severity).alias("severity"), F.create_map(*pairs).alias("change_detail")).cast(CHANGE)


def _records(rows: DataFrame, changes: Column) -> DataFrame:
    return rows.select("source_id", "table_name", F.explode(changes).alias("c")).select("source_id", "c.*", "table_name")


def compare(prev_columns: DataFrame, curr_columns: DataFrame, prev_tables: DataFrame | None = None,
            curr_tables: DataFrame | None = None) -> DataFrame:
    """One row per table with both sides of everything: each input is read once, and all of it meets in one shuffle.

    ``cols``: per column name whether it was and is there and its types; ``was``/``now``: column counts;
    ``hash_before``/``hash_after``; ``rows_before``/``rows_after``: row counts (null where a side lists no such table).
    """
    def columns(df, side):
        return df.select(*TABLE, F.lit(side).alias("side"), "column_name", "data_type", "is_nullable", "ordinal",
                         F.lit(None).cast("double").alias("row_count"))

    def tables(df, side):
        return df.select(*TABLE, F.lit(side).alias("side"), F.lit(None).cast("string").alias("column_name"),
                         F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("boolean").alias("is_nullable"),
                         F.lit(None).cast("int").alias("ordinal"), F.coalesce("row_count", F.lit(0)).cast("double").alias("row_count"))

    rows = columns(prev_columns, 0).unionByName(columns(curr_columns, 1))
    for df, side in ((prev_tables, 0), (curr_tables, 1)):
        rows = rows.unionByName(tables(df, side)) if df is not None else rows
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    # Both aggregates and everything up to here share the shuffle by table.
    pairs = rows.repartition(*TABLE).groupBy(*TABLE, "column_name").agg(
        (F.count_if(F.col("side") == 0) > 0).alias("was"), (F.count_if(F.col("side") == 1) > 0).alias("now"),
        on(0, "data_type").alias("before"), on(1, "data_type").alias("after"), on(0, "is_nullable").alias("null_before"),
        on(1, "is_nullable").alias("null_after"), on(1, "ordinal").alias("ordinal"),
        on(0, "row_count").alias("rows_before"), on(1, "row_count").alias("rows_after"))
    named = F.col("column_name").isNotNull()
    gathered = pairs.groupBy(*TABLE).agg(
        F.collect_list(F.when(named, F.struct("ordinal", "column_name", "was", "now", "before", "after"))).alias("cols"),
        F.collect_list(F.when(named & F.col("was"), _hash_entry("before", "null_before"))).alias("_before"),
        F.collect_list(F.when(named & F.col("now"), _hash_entry("after", "null_after"))).alias("_after"),
        F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after"))
    name = F.col("table_name")
    return gathered.select(
        *TABLE, "cols", F.size("_before").alias("was"), F.size("_after").alias("now"), "rows_before", "rows_after",
        F.when(F.size("_before") > 0, _hash_of(F.col("_before"), name)).alias("hash_before"),
        F.when(F.size("_after") > 0, _hash_of(F.col("_after"), name)).alias("hash_after"))


def _structure() -> Column:
    """All structural changes of a compared table."""
    cols, name = F.col("cols"), F.col("table_name")
    names = F.array_join(F.transform(F.array_sort(F.filter(cols, lambda c: c["now"])), lambda c: c["column_name"]), ",")
    added = _change("new_table", "table", name, "high", {"columns": names, "column_count": F.col("now")})
    gone = _change("dropped_table", "table", name, "critical", {"column_count": F.col("was")})

    def column(c):
        where = {"table": name, "column": c["column_name"]}
        entity = F.concat_ws(".", name, c["column_name"])
        return F.when(~c["was"], _change("new_column", "column", entity, "high", {**where, "data_type": c["after"]})).when(
            ~c["now"], _change("dropped_column", "column", entity, "high", {**where, "data_type": c["before"]})).when(
            ~c["before"].eqNullSafe(c["after"]),
            _change("type_change", "column", entity, "medium", {**where, "before": c["before"], "after": c["after"]}))

    return F.when((F.col("was") == 0) & (F.col("now") == 0), F.array().cast(f"array<{CHANGE}>")).when(
        F.col("was") == 0, F.array(added)).when(F.col("now") == 0, F.array(gone)).otherwise(
        F.array_compact(F.transform(cols, column)))


def _volume() -> Column:
    """Row-count spikes (more than threefold) and drops (by more than 80 % from above 1000) of a compared table."""
    b, a, name = F.col("rows_before"), F.col("rows_after"), F.col("table_name")
    whole = {"before": b.cast("bigint"), "after": a.cast("bigint")}
    spike = _change("row_count_spike", "table", name, "medium", {**whole, "ratio": F.bround(a / F.greatest(b, F.lit(1.0)), 2)})
    drop = _change("row_count_drop", "table", name, "high",
                   {**whole, "drop_pct": F.bround((1 - F.try_divide(a, b)) * 100, 1)})
    return F.array_compact(F.array(F.when((b > 0) & (a > b * 3), spike), F.when((b > 1000) & (a < b * 0.2), drop)))


def diff_schemas(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """All five structural changes.  Nullability is in the hash but is not a change, by definition."""
    return _records(compare(prev, curr), _structure())


def _only(kind: str):
    def changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
        return diff_schemas(prev, curr).where(F.col("change_type") == kind)
    return changes


new_tables, dropped_tables, new_columns, dropped_columns, type_changes = map(
    _only, ("new_table", "dropped_table", "new_column", "dropped_column", "type_change"))


def volume_changes(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Row-count spikes and drops of the tables that both sides list."""
    rows = lambda df, name: df.select(*TABLE, F.coalesce("row_count", F.lit(0)).cast("double").alias(name))
    return _records(rows(prev, "rows_before").join(rows(curr, "rows_after"), list(TABLE)), _volume())


def routes(compared: DataFrame) -> DataFrame:
    """What to compare per source that is there now: nothing known before, same hash, or different hash; and a table of it."""
    hashes = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "|")
    sides = compared.groupBy("source_id").agg(hashes("hash_before").alias("b"), hashes("hash_after").alias("a"),
        F.min(F.when(F.col("now") > 0, F.col("table_name"))).alias("speaker"))
    return sides.where("a <> ''").select("source_id", "speaker", F.when(F.col("b") == "", "initial_scan").when(
        F.col("b") == F.col("a"), "statistics").otherwise("structure").alias("route"))


def should_scan(changes: DataFrame) -> DataFrame:
    """Per source: does any change call for a scan?  A first snapshot does."""
    return changes.groupBy("source_id").agg(F.max(
        F.col("change_type").isin(*SCAN_TRIGGERS) | F.col("severity").isin("high", "critical")).alias("should_scan"),
        F.count(F.lit(1)).alias("changes"))


def scan_scope(changes: DataFrame) -> DataFrame:
    """Tables to scan again, new tables included."""
    return changes.where(F.col("change_type").isin(*SCOPE_TYPES)).select(*TABLE).distinct()


def attach_snapshot(changes: DataFrame, before: Column, after: Column, detected_at: Column) -> DataFrame:
    """Give change records a natural-key id and their snapshots; sentinels without an entity go."""
    return changes.where(F.col("entity_name").isNotNull()).withColumns({
        "snapshot_before": before, "snapshot_after": after, "detected_at": detected_at,
        "change_id": F.substring(F.sha2(F.concat_ws(
            "|", "source_id", "change_type", "entity_name", after.cast("string")), 256), 1, 12)})


def detect_changes(prev_columns: DataFrame, curr_columns: DataFrame,
                   prev_tables: DataFrame, curr_tables: DataFrame) -> DataFrame:
    """Hashes first; each source's route says which comparison counts.

    The comparison of tables is one subplan, used for the routes and for the changes; the routes are joined once, and a
    first snapshot adds its one record at its table with the smallest name.
    """
    compared = compare(prev_columns, curr_columns, prev_tables, curr_tables)
    routed = compared.join(routes(compared), "source_id")
    first = F.array(_change("initial_scan", "source", F.lit(None).cast("string"), "low", {"detail": F.lit("First metadata collection")}))
    changes = F.when(F.col("route") == "structure", _structure()).when(F.col("route") == "statistics", _volume()).when(
        F.col("table_name") == F.col("speaker"), first).otherwise(F.array().cast(f"array<{CHANGE}>"))
    return _records(routed, changes).withColumn(
        "table_name", F.when(F.col("change_type") != "initial_scan", F.col("table_name")))
