"""First-seen and merging semantics, each under its own name.

Frames carry an explicit order ``_ord``.  All merges are grouped aggregations
with map-side combination (``min_by`` with a filter); the one fold whose outcome
depends on the order, ``fold_candidates``, composes the states of its stretches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media as M
from ..functions import url as U
from ..functions.text import is_empty, text
from ..staging import Stage


def first_seen(df: DataFrame, *keys: Column | str, order: str = "_ord") -> DataFrame:
    """The first row of each key; keys may be null."""
    w = Window.partitionBy(*[F.col(k) if isinstance(k, str) else k for k in keys]).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def in_order(rows: Column) -> Column:
    """An array of structs by their ``_ord``; other fields may be of types without an order."""
    return F.array_sort(rows, lambda a, b: F.when(a["_ord"] < b["_ord"], -1).when(a["_ord"] > b["_ord"], 1).otherwise(0))


def first_nonempty(c: str, order: str = "_ord") -> Column:
    """The value of the first row whose value isn't empty."""
    return F.min_by(F.when(~is_empty(F.col(c)), F.col(c)), F.when(~is_empty(F.col(c)), F.col(order)))


#: Columns of harvest records that take the first non-empty value; others keep the first row's.
FILLED = (
    "title", "location_text", "camera_id", "source_url", "source_name", "source_provider", "camera_record_id", "asset_id", "asset_role", "asset_field", "field_path",
    "source_endpoint_url", "source_page_url", "json_record_path", "lat", "lon", "coordinate_source", "direction", "bearing", "heading", "orientation", "in_service",
    "status", "date", "time", "timestamp", "last_updated", "last_refresh", "image_description", "current_image_update_frequency", "reference_image_update_frequency",
)


def _listed(rows: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """``key`` and its values in order, from rows that are distinct by both."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias(out))


def _merged_maps(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``key`` and ``_map``: the first value of each entry by ``order``, empty ones skipped, entries in the order in which they came."""
    entries = rows.select(key, F.col(order).alias("_at"), F.posexplode(F.map_entries("metadata")).alias("_k", "_e"))
    entries = entries.filter(F.col("_e.value").isNotNull() & ~F.col("_e.value").isin("", "[]", "{}"))
    first = entries.groupBy(key, F.col("_e.key").alias("_name")).agg(F.min(F.struct("_at", "_k", F.col("_e.value").alias("v"))).alias("_f"))
    pairs = F.array_sort(F.collect_list(F.struct("_f._at", "_f._k", "_name", "_f.v")))
    return first.groupBy(key).agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["_name"], x["v"]))).alias("_map"))


def merge_harvest_records(df: DataFrame) -> DataFrame:
    """One record for each canonical URL, in first-seen order.

    Listed columns take the first non-empty value, the media type the first
    known one, metadata the first value of each key; ``duplicate_sources`` are
    the other sources, in order.

    A row is taken apart once, into its record, its source and its entries, and all of them
    go through the same two aggregations: what ``df`` is made of is read and computed once.
    """
    own = [f for f in df.schema.fields if f.name not in ("url", "_ord", "metadata")]
    kind = T.StructType([T.StructField("tag", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("r", T.StructType([T.StructField(f.name, f.dataType) for f in own]))])
    part = lambda tag, name=None, k=None, v=None, r=None: F.struct(F.lit(tag).alias("tag"), *[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("name", name), ("k", k), ("v", v), ("r", r))]).cast(kind)
    parts = [F.array(part(0, r=F.struct(*[f.name for f in own]))), F.when(text(F.col("source_url")) != "", F.array(part(1, F.col("source_url")))).otherwise(F.array().cast(T.ArrayType(kind)))]
    if "metadata" in df.columns:
        entries = F.filter(F.transform(F.map_entries("metadata"), lambda e, i: part(2, e["key"], i, e["value"])), lambda x: x["v"].isNotNull() & ~x["v"].isin("", "[]", "{}"))
        parts.append(F.coalesce(entries, F.array().cast(T.ArrayType(kind))))
    rows = df.select(U.canonical(F.col("url")).alias("_key"), "_ord", F.explode(F.concat(*parts)).alias("_p")).select("_key", "_ord", F.col("_p.tag").alias("_tag"), F.col("_p.name").alias("_name"), F.col("_p.k").alias("_k"), F.col("_p.v").alias("_v"), F.col("_p.r").alias("_r"))
    aggs = []
    for f in own:
        c = f.name
        if c != "media_type":
            aggs.append((first_nonempty(f"_r.{c}") if c in FILLED else F.min_by(F.struct(f"_r.{c}"), "_ord")[c]).alias(c))
    known = F.when(F.col("_r.media_type") != "unknown_media", F.col("_r.media_type"))
    aggs.append(F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("_ord"))), F.lit("unknown_media")).alias("media_type"))
    # A popular URL may have any number of rows, but each source and entry counts once: arrays hold what is distinct.
    once = rows.groupBy("_key", "_tag", "_name").agg(F.min("_ord").alias("_at"), F.min(F.struct("_ord", "_k", "_v")).alias("_f"), *aggs)
    of = lambda tag, *cs: F.when(F.col("_tag") == tag, F.struct(*cs))
    sources = F.transform(F.array_sort(F.collect_list(of(1, "_at", "_name"))), lambda x: x["_name"])
    pairs = F.array_sort(F.collect_list(of(2, "_f._ord", "_f._k", "_name", "_f._v")))
    whole = once.groupBy("_key").agg(
        F.any_value(of(0, "_at", *[f.name for f in own]), F.lit(True)).alias("_r"),
        sources.alias("_sources"),
        F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["_name"], x["_v"]))).alias("_map"),
    )
    fields = {"_ord": F.col("_r._at"), "url": F.col("_key"), "metadata": F.col("_map")}
    others = F.array_remove("_sources", F.coalesce("_r.source_url", F.lit("")))
    return whole.select(*[fields.get(c, F.col(f"_r.{c}")).alias(c) for c in ("_ord", *[c for c in df.columns if c != "_ord"])], others.alias("duplicate_sources"))


#: Metadata that a structured row overrides in the fold.
OVERRIDES = (
    "camera_id", "camera_name", "camera_type", "raw_camera_type", "location_display", "camera_refresh_rate", "refresh_rate_seconds", "map_refresh_rate_seconds",
    "image_snapshot_refresh_delay_seconds", "json_metadata_extracted", "json_endpoint_url", "json_record_path", "json_record_schema_hint",
)


def _filled(own: Column, other: Column) -> Column:
    """``own`` with the entries of ``other`` for keys that it lacks or has empty."""
    full = F.map_filter(own, lambda k, v: v.isNotNull() & (v != ""))
    more = F.map_filter(other, lambda k, v: ~F.map_contains_key(full, k))
    kept = F.map_filter(own, lambda k, v: F.map_contains_key(full, k) | ~F.map_contains_key(more, k))
    return F.map_concat(kept, more)


def _overridden(own: Column, other: Column) -> Column:
    """``own`` with the named entries of ``other`` on top."""
    over = F.map_filter(other, lambda k, v: k.isin(*OVERRIDES))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(over, k)), over)


#: Rows of one URL that are folded within its aggregation, row by row; URLs of more rows are folded across partitions, where a row costs far less.
CROWD = 100


def fold_candidates(df: DataFrame, *keys: str, crowd: int = CROWD) -> DataFrame:
    """One candidate for each canonical URL (and ``keys``) by an order-dependent fold.

    1. An HLS row replaces one that isn't, as it is.
    2. A located row replaces an unlocated one, or one from no structured source
       if it is from one; empty metadata is back-filled.
    3. Otherwise empty title, location and metadata are filled; a structured row
       wins those, and overrides the named metadata, where the other isn't one.

    The place of the first row is kept.  ``_ord`` differs within a URL.  A URL of
    up to ``crowd`` rows is folded inside its aggregation, so no array is longer;
    of larger ones only orders and states are dealt by ranges (``_fold_crowds``),
    and the outcome is the same.
    """
    fields = [c for c in df.columns if c != "_ord"]
    url = F.regexp_replace(U.canonical(F.col("stream_url")), "(?s)#.*$", "")
    first = Stage(df.sparkSession)  # a URL costs more than all that follows, so it is made once
    rows = first(df.withColumn("stream_url", url).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>"))), "fold-urls")
    names = [f"_g{i}" for i in range(len(keys) + 1)]
    rows = rows.select("*", *[F.col(c).alias(n) for c, n in zip((*keys, "stream_url"), names)])
    counts = rows.groupBy(*names).agg(F.count("*").alias("_c"), F.min("_ord").alias("_first"))
    seen, stage = Observation(), Stage(df.sparkSession)
    crowds = counts.observe(seen, F.count_if(F.col("_c") <= crowd).alias("few")).filter(F.col("_c") > crowd).drop("_c")
    crowds = stage(crowds.withColumn("_g", F.monotonically_increasing_id()), "fold-crowds")
    if crowds.isEmpty():
        stage.free()
        return _fold_few(rows, names, fields).select(*df.columns)
    other = crowds.withColumnsRenamed({n: f"{n}b" for n in names})
    meet = _same(rows, other, names)
    folded = _fold_crowds(rows.join(other, meet), fields, stage).select(*df.columns)
    if not seen.get["few"]:
        first.free()
        return folded
    return _fold_few(rows.join(other, meet, "left_anti"), names, fields).select(*df.columns).unionByName(folded)


def _same(left: DataFrame, right: DataFrame, names: list[str], suffix: str = "b") -> Column:
    """Equal groups, nulls included; the right side's names end in ``suffix``."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{n}{suffix}"))
    return out


def _kind(r) -> Column:
    return M.type_for_caps(F.try_element_at(r["metadata"], F.lit("media_type")), r["stream_url"])


def _located(r) -> Column:
    return r["lat"].isNotNull() & r["lon"].isNotNull()


def _structured(r) -> Column:
    return ~F.lower(text(F.try_element_at(r["metadata"], F.lit("json_metadata_extracted")))).isin("", "false", "0")


def _fold_few(rows: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    packed = rows.groupBy(*names).agg(in_order(F.collect_list(F.struct("_ord", F.struct(*fields).alias("r")))).alias("_rows"))

    def rebuilt(r: Column, **new: Column) -> Column:
        return F.struct(*[new.get(f, r[f]).alias(f) for f in fields])

    def step(old: Column, row: Column) -> Column:
        better = _structured(row) & ~_structured(old)
        take = lambda f: F.when((text(row[f]) != "") & ((text(old[f]) == "") | better), row[f]).otherwise(old[f])
        meta = F.when(_structured(row), _overridden(_filled(old["metadata"], row["metadata"]), row["metadata"])).otherwise(_filled(old["metadata"], row["metadata"]))
        return (
            F.when((_kind(row) == "hls") & (_kind(old) != "hls"), row)
            .when(_located(row) & (~_located(old) | better), rebuilt(row, metadata=_filled(row["metadata"], old["metadata"])))
            .otherwise(rebuilt(old, title=take("title"), location_text=take("location_text"), metadata=meta))
        )

    folded = F.aggregate(F.slice(F.col("_rows"), F.lit(2), F.size("_rows")), F.col("_rows")[0]["r"], lambda acc, x: step(acc, x["r"]))
    return packed.select(F.col("_rows")[0]["_ord"].alias("_ord"), folded.alias("r")).select("_ord", "r.*")


#: What the fold's choices depend on, of a row or of the result so far: the declared
#: type (none, HLS, another), the mark of structured sources (none, false, true), and
#: whether it is located.  As one number: ``type * 6 + mark * 2 + located``.
STATES = 18
#: What a row does: replaces all, replaces and is back-filled, fills; the last one as a structured row, and where the result isn't one.
REPLACES, BACKED, FILLS, FILLS_STRUCTURED, FILLS_BETTER = range(5)


def _next(state: int, row: int, hls_url: bool) -> tuple[int, int]:
    """The result's state after a row of this state, and what the row does."""
    (t, m, at), (rt, rm, rat) = ((x // 6, x // 2 % 3, x % 2) for x in (state, row))
    is_hls = lambda t: t == 1 or (t == 0 and hls_url)
    better = rm == 2 and m != 2
    if is_hls(rt) and not is_hls(t):
        return row, REPLACES
    if rat and (not at or better):
        return (rt or t) * 6 + (rm or m) * 2 + 1, BACKED
    # A structured row overrides the mark; the type is only filled.
    return (t or rt) * 6 + (2 if rm == 2 else m or rm) * 2 + at, FILLS_BETTER if better else FILLS_STRUCTURED if rm == 2 else FILLS


def _fold_crowds(rows: DataFrame, fields: list[str], stage: Stage) -> DataFrame:
    """The same fold for URLs of any number of rows, numbered by ``_g``, with ``_first`` of each.

    Its choices depend on 18 states only, so what a stretch of rows does is a table
    of 18 outcomes, and tables of stretches compose.  Numbers, orders and states are
    range-partitioned; each partition sends the table of the URL that it begins with and
    the state in which it ends, one row for each partition; from these follows the
    state in which each begins.  A second pass tells the few rows that shape a URL: the last
    that replaces all, those after it that are back-filled (two at most: the first makes it
    located, the second structured), and the first structured one after those.

    What other rows do follows from these.  Which row gives a text or an entry is the least
    or greatest order of some, by aggregations of numbers; only such rows are then read whole.
    """
    spark, work = rows.sparkSession, Stage(rows.sparkSession)
    meta = lambda k: F.lower(text(F.try_element_at("metadata", F.lit(k))))
    url_is_hls = (M.type_for_caps(F.lit(None).cast("string"), F.col("stream_url")) == "hls").cast("int")
    declared = M.type_for_caps(F.try_element_at("metadata", F.lit("media_type")), F.col("stream_url"))
    kind = F.when(meta("media_type") == "", 0).when(declared == "hls", 1).otherwise(2)
    mark = F.when(meta("json_metadata_extracted") == "", 0).when(meta("json_metadata_extracted").isin("false", "0"), 1).otherwise(2)
    state = (kind * 6 + mark * 2 + _located({k: F.col(k) for k in ("lat", "lon")}).cast("int")).cast("int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = work(rows.select("_g", "_first", "_ord", state.alias("_s"), url_is_hls.alias("_u"), *fields), "fold-rows")
    lean = work(rows.select("_g", "_ord", "_s", "_u").repartitionByRange(n, "_g", "_ord").withColumn("_part", F.spark_partition_id()), "fold-states")
    lean = lean.repartition(n, "_part").sortWithinPartitions("_part", "_g", "_ord")
    steps = {u: [[_next(s, r, bool(u)) for r in range(STATES)] for s in range(STATES)] for u in (0, 1)}

    def ends(frames):
        """For each partition: its first group and what it does there, its last group and the state after it."""
        seen: dict[int, list] = {}
        for frame in frames:
            for part, key, s, u in zip(*(list(frame[c]) for c in ("_part", "_g", "_s", "_u"))):
                at = seen.get(part)
                if at is None:  # first group, its table, last group, its state (None while it is the first one)
                    seen[part] = [key, [steps[u][x][s][0] for x in range(STATES)], key, None, s]
                elif at[2] == key:
                    if at[3] is None:
                        at[1] = [steps[u][x][s][0] for x in at[1]]
                        at[4] = steps[u][at[4]][s][0]
                    else:
                        at[3] = steps[u][at[3]][s][0]
                else:
                    at[2], at[3] = key, s
        yield pd.DataFrame([(p, a[0], a[1], a[2], a[3], a[4]) for p, a in seen.items()], columns=["_part", "head", "does", "tail", "after", "alone"]).astype({"after": "Int64"})

    told = lean.mapInPandas(ends, "_part int, head long, does array<int>, tail long, after int, alone int").orderBy("_part").collect()  # one row for each partition
    begins: dict[int, tuple[int, int]] = {}
    carried: tuple[int, int] | None = None
    for r in told:
        if carried and carried[0] == r["head"]:
            begins[r["_part"]] = carried
            first = r["does"][carried[1]]
        else:
            first = r["alone"]
        carried = (r["tail"], first if r["after"] is None else r["after"])

    def shaping(frames):
        """The rows that shape each group of a partition, as far as the partition knows."""
        part = key = now = None
        held: list[tuple] = []
        for frame in frames:
            out = []
            for p, k, o, s, u in zip(*(list(frame[c]) for c in ("_part", "_g", "_ord", "_s", "_u"))):
                if p != part:
                    out += held
                    held, part, (key, now) = [], p, begins.get(p, (None, None))
                if k != key:
                    out += held
                    held, key, now = [(k, o, REPLACES)], k, s
                    continue
                now, does = steps[u][now][s]
                if does == REPLACES:
                    held = [(k, o, does)]
                elif does in (BACKED, FILLS_BETTER):
                    held.append((k, o, does))
            yield pd.DataFrame(out, columns=["_g", "_ord", "_does"])
        yield pd.DataFrame(held, columns=["_g", "_ord", "_does"])

    orders = lean.schema["_ord"].dataType.simpleString()
    of = lambda *does: F.when(F.col("_does").isin(*does), F.col("_ord"))
    spans = lean.mapInPandas(shaping, f"_g long, _ord {orders}, _does int").groupBy("_g").agg(
        F.max(of(REPLACES)).alias("_from"), F.max(of(REPLACES, BACKED)).alias("_base"), F.collect_list(of(BACKED)).alias("_backed"), F.max(of(FILLS_BETTER)).alias("_better")
    )
    spans = work(spans, "fold-spans")
    late = rows.join(spans, "_g").filter(F.col("_ord") >= F.col("_from"))
    full, at = lambda c: text(F.col(c)) != "", lambda when, what=min: getattr(F, what.__name__)(F.when(when, F.col("_ord")))
    # A text is that of the row which overrides it, else the first from the base on; what no row fills stays as the base has it.
    after = F.col("_ord") >= F.col("_base")
    texts = late.filter(after).groupBy("_g", "_first", "_base").agg(
        *[F.coalesce(at(full(c) & (F.col("_ord") == F.col("_better"))), at(full(c)), F.col("_base")).alias(f"_{c}") for c in ("title", "location_text")]
    )
    texts = stage(texts, "fold-texts")
    backed = F.array_contains("_backed", F.col("_ord"))
    entry = late.select("_g", "_ord", "_from", backed.alias("_is_backed"), (F.floor(F.col("_s") / 2) % 3 == 2).alias("_structured"), F.explode("metadata").alias("_k", "_v"))
    sets = (F.col("_ord") == F.col("_from")) | F.when(F.col("_is_backed"), full("_v")).otherwise(F.col("_structured") & F.col("_k").isin(*OVERRIDES))
    entry = entry.withColumn("_sets", sets)
    last = entry.groupBy("_g", "_k").agg(at(F.col("_sets"), max).alias("_at"), at(F.col("_sets") & full("_v"), max).alias("_full"), F.max("_ord").alias("_any"))
    last = work(last, "fold-entries")
    # An entry is that of the last row which sets it; if that is empty, the first later one that isn't.
    bare = last.filter(~F.col("_at").eqNullSafe(F.col("_full")) | F.col("_at").isNull()).select("_g", "_k", "_at")
    given = F.coalesce("_at", "_any")
    if bare.isEmpty():
        entries = last.select("_g", "_k", given.alias("_ord"))
    else:
        fills = entry.filter(full("_v") & ~F.col("_sets") & ~F.col("_is_backed")).join(bare, ["_g", "_k"]).filter(F.col("_at").isNull() | (F.col("_ord") > F.col("_at")))
        fills = fills.groupBy("_g", "_k").agg(F.min("_ord").alias("_fill"))
        entries = last.join(fills, ["_g", "_k"], "left").select("_g", "_k", F.coalesce("_fill", given).alias("_ord"))
    entries = stage(entries, "fold-given")
    wanted = texts.select("_g", F.explode(F.array("_base", "_title", "_location_text")).alias("_ord")).unionByName(entries.select("_g", "_ord")).distinct()
    read = stage(rows.drop("_first").join(wanted, ["_g", "_ord"], "left_semi"), "fold-read")
    work.free()
    row = lambda c, *fields: F.any_value(F.when(F.col("_ord") == F.col(c), F.struct(*fields)), F.lit(True)).alias(c)
    whole = read.join(texts, "_g").groupBy("_g").agg(F.min("_first").alias("_first"), row("_base", *[c for c in fields if c not in ("title", "location_text", "metadata")]), row("_title", "title"), row("_location_text", "location_text"))
    maps = read.select("_g", "_ord", F.explode("metadata").alias("_k", "_v")).join(entries, ["_g", "_k", "_ord"]).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("metadata"))
    place = {c: F.col(f"_{c}.{c}") for c in ("title", "location_text")} | {"metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))}
    return whole.join(maps, "_g", "left").select(F.col("_first").alias("_ord"), *[place.get(c, F.col(f"_base.{c}")).alias(c) for c in fields])


def merge_target_sets(df: DataFrame) -> DataFrame:
    """First candidate of each (URL without fragment, target) in the order of sets; nothing is merged."""
    w = Window.partitionBy(U.without_fragment(F.col("stream_url")), F.col("target_id")).orderBy("set_ord", "_ord")
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def merge_search_rows(df: DataFrame) -> DataFrame:
    """One search result for each URL: engines in order of appearance, provider ``blind:multi`` for several, empty texts filled."""
    filled = [first_nonempty(c).alias(c) for c in ("title", "snippet", "query", "source_name") if c in df.columns]
    out = df.groupBy("url").agg(F.min("_ord").alias("_ord"), F.min_by("source_provider", "_ord").alias("source_provider"), F.min_by("search_engine", "_ord").alias("search_engine"), *filled)
    seen = df.filter(text(F.col("search_engine")) != "").groupBy("url", F.col("search_engine").alias("_engine")).agg(F.min("_ord").alias("_at"))
    out = out.join(_listed(seen, "url", "_at", "_engine", "search_engines"), "url", "left").withColumn("search_engines", F.coalesce("search_engines", F.array().cast("array<string>")))
    return out.withColumn("source_provider", F.when(F.size("search_engines") > 1, "blind:multi").otherwise(F.col("source_provider")))


def merge_endpoints(df: DataFrame) -> DataFrame:
    """One row for each endpoint: largest counts, flags of any, last metadata, the rest of the first."""
    most = ("record_count", "camera_record_count", "media_asset_count")
    flags = ("has_coordinates", "has_timestamps", "has_service_status", "has_refresh_metadata")
    first = [c for c in df.columns if c not in (*most, *flags, "endpoint_url", "_ord", "metadata")]
    aggs = [*[F.max(c).alias(c) for c in most], *[F.bool_or(c).alias(c) for c in flags], *[F.min_by(F.struct(c), "_ord")[c].alias(c) for c in first]]
    out = df.groupBy("endpoint_url").agg(F.min("_ord").alias("_first"), *aggs).withColumnRenamed("_first", "_ord")
    if "metadata" in df.columns:
        # Later values win: merged in reverse order.
        maps = _merged_maps(df.withColumn("_back", -F.col("_ord")), "endpoint_url", "_back")
        out = out.join(maps, "endpoint_url", "left").withColumn("metadata", F.coalesce("_map", F.create_map().cast("map<string,string>"))).drop("_map")
    return out.select(*df.columns)


def first_cameras(records: DataFrame) -> DataFrame:
    """First record of each camera id."""
    return first_seen(records, "camera_record_id")


def first_playlist_rows(df: DataFrame, url: str = "stream_url") -> DataFrame:
    """First row of each (URL without fragment, target); rows without a URL go."""
    return first_seen(df.filter(text(F.col(url)) != ""), U.without_fragment(F.col(url)), F.col("target_id"))
