"""Ingestion of JSON records whose schema drifts from file to file.

The target schema is (submission_id STRING, features VEC).  Ingestion has three
steps, all of them column expressions:

1. *Enforce*: a field that bears a target name and casts to the target type
   fills the typed column; every other field, and every value that does not
   cast, goes to the rescue column as JSON by field name.  Records are parsed
   once, here.
2. *Promote*: per file, the field that plays a target role under another name
   is proposed (``file_roles``) and, if it is on the list of approvals, promoted.
   Without a list every proposal stands.
3. *Replay*: rescued values of promoted fields are cast into the typed columns
   and leave the rescue column.

``schema_changes`` compares each file with the previous month of its feed on
the typed and rescued columns of the ingested table and reports renamed,
removed, added and retyped fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import durable

VEC = "struct<kind:tinyint,dim:int,idx:array<int>,vals:array<double>>"
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
SPARSE_TEXT = r"^\s*\(\s*(\d+)\s*,\s*\[([^\]]*)\]\s*,\s*\[([^\]]*)\]\s*\)\s*$"
#: An id is a whole number of at least this size, as a string or an integer.
LEAST_ID = 100_000
KINDS = ("string", "array", "object", "integer", "fraction", "boolean")
#: The typed columns.
TARGETS = ("submission_id", "features")


def json_kind(value: Column) -> Column:
    """string, array, object, integer, fraction or boolean; null for a JSON null.

    A number written with a point or an exponent is a fraction, also 1.0.
    """
    return F.when(value.isNotNull(), _kind_of(F.schema_of_variant(value)))


def _kind_of(t: Column) -> Column:
    """``json_kind`` from the text of a variant's schema."""
    return (
        F.when(t == "VOID", None)
        .when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .when(t == "BOOLEAN", "boolean")
        .when(t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")  # integers beyond 64 bits
        .otherwise("fraction")
    )


def _number(text: Column) -> Column:
    """One spelling per number; integers too long for a double keep their digits."""
    digits = F.regexp_replace(F.trim(text), r"^\+", "")
    return F.when(digits.rlike(r"^-?\d{16,}$"), digits).otherwise((digits.try_cast("double") + F.lit(0.0)).cast("string"))


def _sparse_text(idx: Column, vals: Column) -> Column:
    pairs = F.filter(F.arrays_zip(idx.alias("i"), vals.alias("v")), lambda p: F.coalesce(p["v"], F.lit(0.0)) != 0)
    return F.concat(F.lit("v:"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws(":", p["i"].cast("string"), p["v"].cast("string"))), ","))


def vector_text(vec: Column) -> Column:
    """``v:`` and the non-zero positions and values of a VEC in order; null for null."""
    dense = _sparse_text(F.sequence(F.lit(0), F.greatest(F.size(vec["vals"]) - 1, F.lit(0))), vec["vals"])
    return F.when(vec["kind"] == 0, _sparse_text(vec["idx"], vec["vals"])).when(vec["kind"] == 1, dense)


def _split(text: Column, kind: str) -> Column:
    return F.when(F.trim(text) == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast(kind)))


def to_vector(value: Column) -> Column:
    """A JSON value as VEC, or null where it is no vector.

    Understood are objects with ``indices``/``values`` (or ``values`` alone),
    arrays of numbers, and the text ``(size,[positions],[values])``.
    """
    idx, vals = F.try_variant_get(value, "$.indices", "array<int>"), F.try_variant_get(value, "$.values", "array<double>")
    size = F.try_variant_get(value, "$.size", "int")
    text = F.try_variant_get(value, "$", "string")
    dense = F.try_variant_get(value, "$", "array<double>")

    def vec(kind: int, dim: Column, i: Column, v: Column) -> Column:
        return F.struct(F.lit(kind).cast("tinyint").alias("kind"), dim.cast("int").alias("dim"), i.cast("array<int>").alias("idx"), v.cast("array<double>").alias("vals"))

    none = F.lit(None)
    kind = json_kind(value)
    in_text = [F.regexp_extract(text, SPARSE_TEXT, k) for k in (1, 2, 3)]
    return (
        F.when((kind == "object") & idx.isNotNull() & vals.isNotNull(), vec(0, size, idx, vals))
        .when((kind == "object") & vals.isNotNull(), vec(1, none, none, vals))
        .when((kind == "array") & dense.isNotNull() & ~F.exists(dense, lambda x: x.isNull()), vec(1, none, none, dense))
        .when((kind == "string") & text.rlike(SPARSE_TEXT), vec(0, in_text[0].try_cast("int"), _split(in_text[1], "int"), _split(in_text[2], "double")))
    )


def canonical(value: Column) -> Column:
    """Text by which values are compared; null for a JSON null.

    Numbers compare as numbers whatever their type, vectors by their non-zero
    positions whatever their form, all else by its JSON text.
    """
    kind = json_kind(value)
    text = F.try_variant_get(value, "$", "string")
    vec = to_vector(value)
    return (
        F.when(kind.isNull(), None)
        .when(kind.isin("integer", "fraction"), _number(text))
        .when((kind == "string") & text.rlike(NUMBER), _number(text))
        .when(vec.isNotNull(), vector_text(vec))
        .when(kind == "string", F.concat(F.lit("s:"), text))
        .otherwise(F.concat(F.lit("j:"), F.to_json(value)))
    )


def _is_id(text: Column) -> Column:
    """Is it a whole number of at least ``LEAST_ID``?"""
    x = F.when(text.rlike(NUMBER), text).try_cast("double")
    return F.coalesce((x >= LEAST_ID) & (x == F.floor(x)), F.lit(False))


def _identifier(value: Column, kind: Column) -> Column:
    """An id as text, or null where the value is none."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(kind.isin("string", "integer") & _is_id(text), text)


def landed(raw: DataFrame) -> DataFrame:
    """Step 1: file and row, submission_id, id_kind, features, vec_kind, rescued.

    ``rescued`` maps a field to its JSON kind and text.  Unreadable records
    (also such that name a key twice or are no object), and rows without a file
    or series, take no part.
    """
    fields = F.try_variant_get(F.try_parse_json("record"), "$", "map<string,variant>")
    parsed = raw.select("series_id", "file_id", "file_month", "row_no", fields.alias("m")).filter("m is not null and file_id is not null and series_id is not null and file_month is not null")
    target = lambda name: F.try_element_at("m", F.lit(name))
    typed = parsed.select("*", json_kind(target(TARGETS[0])).alias("id_kind"), json_kind(target(TARGETS[1])).alias("vec_kind"))
    typed = typed.select("*", _identifier(target(TARGETS[0]), F.col("id_kind")).alias("submission_id"), to_vector(target(TARGETS[1])).alias("features"))
    flags = typed.select("*", F.array_compact(F.array(F.when(F.col("submission_id").isNotNull(), TARGETS[0]), F.when(F.col("features").isNotNull(), TARGETS[1]))).alias("used"))
    # the kind in two steps, as an expression inside a lambda is evaluated wherever it is named
    texts = F.transform(F.map_entries(F.map_filter("m", lambda k, v: ~F.array_contains("used", k))), lambda e: F.struct(e["key"].alias("field"), F.schema_of_variant(e["value"]).alias("t"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))
    rescued = F.map_from_entries(F.transform(texts, lambda e: F.struct(e["field"], F.struct(_kind_of(e["t"]).alias("kind"), e["json"].alias("json")))))
    return flags.select("series_id", "file_id", "file_month", "row_no", "submission_id", "id_kind", "features", "vec_kind", rescued.alias("rescued"))


def inventory(records: DataFrame) -> DataFrame:
    """Per file and field of landed records: its JSON kinds (a bit each), and in how many records it is an id or a vector."""
    keep = ["series_id", "file_id", "file_month"]
    nothing = F.lit(None).cast("string")
    rescued = F.transform(F.map_entries("rescued"), lambda e: F.struct(e["key"].alias("field"), e["value"]["kind"].alias("kind"), e["value"]["json"].alias("json"), nothing.alias("typed")))
    own = lambda value, kind, name: F.when(F.col(value).isNotNull(), F.struct(F.lit(name).alias("field"), F.col(kind).alias("kind"), nothing.alias("json"), F.lit(name).alias("typed")))
    typed = F.array_compact(F.array(own("submission_id", "id_kind", TARGETS[0]), own("features", "vec_kind", TARGETS[1])))
    x = records.select(*keep, F.explode(F.concat(rescued, typed)).alias("f")).select(*keep, "f.*")
    bare = F.when(F.col("kind") == "integer", F.col("json")).when(F.col("kind") == "string", F.regexp_extract("json", r'^"\s*([-+.0-9eE]+)\s*"$', 1))
    may_be = (F.col("kind") == "array") | ((F.col("kind") == "object") & F.col("json").contains('"values"')) | ((F.col("kind") == "string") & F.col("json").rlike(r'^"\s*\('))
    vector = (F.col("typed") == TARGETS[1]) | (F.col("typed").isNull() & F.when(may_be, to_vector(F.try_parse_json("json")).isNotNull()).otherwise(False))
    return x.groupBy(*keep, "field").agg(
        F.coalesce(F.bit_or(sum((F.when(F.col("kind") == k, 1 << i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))), F.lit(0)).alias("kinds"),
        F.count_if((F.col("typed") == TARGETS[0]) | (F.col("typed").isNull() & _is_id(bare))).alias("ids"),
        F.count_if(vector).alias("vectors"),
    )


def file_roles(inventory: DataFrame) -> DataFrame:
    """Per file: the fields proposed for the roles of the target columns, and its neighbours.

    The id field is the one of the target name if it holds ids, else the field
    with most id values (the first by name at a tie); likewise for the vector.
    A role nobody plays is null.  The previous file is that of the latest
    earlier month of the series (the greatest file_id if a month has several).
    """
    def player(target: str, hits: str) -> Column:
        rank = F.struct((F.col("field") != target).alias("other"), (-F.col(hits)).alias("n"), F.col("field").alias("tie"))
        return F.min_by(F.when(F.col(hits) > 0, F.col("field")), F.when(F.col(hits) > 0, rank))

    files = inventory.groupBy("series_id", "file_month", "file_id").agg(player(TARGETS[0], "ids").alias("id_field"), player(TARGETS[1], "vectors").alias("vector_field"))
    months = files.groupBy("series_id", "file_month").agg(F.max("file_id").alias("last"))
    order = Window.partitionBy("series_id").orderBy("file_month")
    months = months.select("series_id", "file_month", F.lag("last").over(order).alias("prev_file"))
    return files.join(months, ["series_id", "file_month"])


def _approved(roles: DataFrame, approvals: DataFrame | None) -> DataFrame:
    """``roles`` without the proposals that ``approvals`` (series_id, field, target) lacks; a target's own name needs none."""
    if approvals is None:
        return roles
    for target, role in zip(TARGETS, ("id_field", "vector_field")):
        known = approvals.filter(F.col("target") == target).select("series_id", F.col("field").alias(role), F.lit(True).alias("__ok")).distinct()
        roles = roles.join(known, ["series_id", role], "left").withColumn(role, F.when(F.col("__ok") | (F.col(role) == target), F.col(role))).drop("__ok")
    return roles


def replayed(records: DataFrame, roles: DataFrame) -> DataFrame:
    """Steps 2 and 3: landed records, the rescued values of their files' roles cast into the typed columns."""
    x = records.join(roles.select("file_id", "id_field", "vector_field"), "file_id", "left")
    of = lambda role, target: F.when(F.col(role) != target, F.try_element_at("rescued", F.col(role)))
    x = x.select("*", of("id_field", TARGETS[0]).alias("__i"), of("vector_field", TARGETS[1]).alias("__v"))
    x = x.select("*", F.try_parse_json("__i.json").alias("__iv"), F.try_parse_json("__v.json").alias("__vv"))
    x = x.select("*", _identifier(F.col("__iv"), F.col("__i.kind")).alias("__id"), to_vector(F.col("__vv")).alias("__vec"))
    taken = F.array_compact(F.array(F.when(F.col("__id").isNotNull(), F.col("id_field")), F.when(F.col("__vec").isNotNull(), F.col("vector_field"))))
    x = x.select("*", taken.alias("__taken"))
    return x.select(
        "series_id", "file_id", "file_month", "row_no", F.coalesce("__id", "submission_id").alias("submission_id"), F.when(F.col("__id").isNotNull(), F.col("__i.kind")).otherwise(F.col("id_kind")).alias("id_kind"),
        F.coalesce("__vec", "features").alias("features"), F.when(F.col("__vec").isNotNull(), F.col("__v.kind")).otherwise(F.col("vec_kind")).alias("vec_kind"), "id_field", "vector_field",
        F.map_filter("rescued", lambda k, v: ~F.array_contains("__taken", k)).alias("rescued"),
    )


def schema_changes(raw: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """file_id, change_kind, old_field, new_field of each file against its predecessor, from the ingested table.

    A rename is found by signature, not by trying pairs: over the submissions
    both files share, each field that only one file has is summed up as (number
    of values, sum and xor of hashes of (submission, value)); an old and a new
    field with one signature are a rename.  If several fields share a signature
    they are matched in order of their names.  Fields whose shared values are
    all null are never renamed.  Only values of fields that one file lacks are
    brought into comparable form and shuffled; of a record that a file repeats
    the greatest value counts.  Empty input gives no rows.
    """
    land = durable(landed(raw))
    known = durable(inventory(land))
    roles = durable(_approved(file_roles(known), approvals))
    records = replayed(land, roles)
    pairs = roles.filter("prev_file is not null").select(F.col("file_id").alias("new_file"), F.col("prev_file").alias("old_file"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("new_file").alias("file_id"), F.lit(True).alias("newer"), F.col("new_file").alias("pair")), F.struct(F.col("old_file").alias("file_id"), F.lit(False).alias("newer"), F.col("new_file").alias("pair")))).alias("s")).select("s.*")

    here = sides.join(known.select("file_id", "field", "kinds"), "file_id")
    fields = here.groupBy("pair", "field").agg(
        F.max("newer").alias("in_new"), F.min("newer").alias("only_new"),
        F.max(F.when(F.col("newer"), F.col("kinds"))).alias("new_kinds"), F.max(F.when(~F.col("newer"), F.col("kinds"))).alias("old_kinds"),
    )
    fields = durable(fields)
    one_sided = fields.filter(F.col("in_new") == F.col("only_new")).select("pair", "field", F.col("in_new").alias("newer"), F.coalesce("new_kinds", "old_kinds").alias("kinds"))

    sid = _number(F.col("submission_id"))
    shared = records.filter("submission_id is not null").select("file_id", sid.alias("sid")).join(sides, "file_id").groupBy("pair", "sid").agg(F.count_if("newer").alias("n"), F.count_if(~F.col("newer")).alias("o")).filter("n > 0 and o > 0").select("pair", "sid")
    # per file the few fields that a neighbour lacks; only these are looked up in a record
    wanted = one_sided.join(sides, ["pair", "newer"]).groupBy("file_id").agg(F.collect_list(F.struct("field", "pair", "newer")).alias("wanted"))
    each = records.filter("submission_id is not null").join(wanted, "file_id").select("id_field", "vector_field", "features", "rescued", sid.alias("sid"), F.explode("wanted").alias("w"))
    held = F.col("rescued")[F.col("w.field")]
    each = each.select("w.*", "sid", "features", F.when(F.col("w.field") == F.col("id_field"), TARGETS[0]).when((F.col("w.field") == F.col("vector_field")) & F.col("features").isNotNull(), TARGETS[1]).alias("typed"), held["json"].alias("json"))
    each = each.filter("typed is not null or json <> 'null'").withColumn("value", F.try_parse_json("json"))
    canon = F.when(F.col("typed") == TARGETS[0], F.col("sid")).when(F.col("typed") == TARGETS[1], vector_text(F.col("features"))).otherwise(canonical(F.col("value")))
    values = each.select("pair", "newer", "field", "sid", canon.alias("canon")).groupBy("pair", "newer", "field", "sid").agg(F.max("canon").alias("canon")).join(shared, ["pair", "sid"])
    signature = values.groupBy("pair", "newer", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("sid", "canon"), 28)).alias("s"), F.bit_xor(F.xxhash64("canon", "sid")).alias("x"))
    signed = one_sided.join(signature, ["pair", "newer", "field"], "left")
    place = F.row_number().over(Window.partitionBy("pair", "newer", "n", "s", "x").orderBy("field"))
    signed = durable(signed.withColumn("place", place))
    old = signed.filter("not newer").select("pair", "n", "s", "x", "place", F.col("field").alias("old_field"), F.col("kinds").alias("was"))
    new = signed.filter("newer").select("pair", "n", "s", "x", "place", F.col("field").alias("new_field"), F.col("kinds").alias("now"))
    matched = old.join(new, ["pair", "n", "s", "x", "place"], "full")
    nothing = F.lit("")
    one = matched.select("pair", F.when(F.col("old_field").isNull(), "added").when(F.col("new_field").isNull(), "removed").otherwise("renamed").alias("change_kind"), F.coalesce("old_field", nothing).alias("old_field"), F.coalesce("new_field", nothing).alias("new_field"))
    differ = lambda a, b: (F.col(a) != 0) & (F.col(b) != 0) & (F.col(a) != F.col(b))
    kept = fields.filter((F.col("in_new") != F.col("only_new")) & differ("old_kinds", "new_kinds")).select("pair", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    moved = matched.filter(F.col("old_field").isNotNull() & F.col("new_field").isNotNull() & differ("was", "now")).select("pair", F.lit("retyped").alias("change_kind"), "old_field", "new_field")
    return one.unionByName(kept).unionByName(moved).withColumnRenamed("pair", "file_id")


def ingest(raw: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """All readable records in one table: file and row, submission_id, features, rescued.

    ``rescued`` maps field names to JSON text and holds everything that has no
    typed place.  A record without an id keeps a null submission_id.
    ``approvals`` (series_id, field, target) lists what may be promoted; without
    it every proposal is.
    """
    land = durable(landed(raw))
    out = replayed(land, _approved(file_roles(inventory(land)), approvals))
    return out.select("series_id", "file_id", "file_month", "row_no", "submission_id", "features", F.transform_values("rescued", lambda k, v: v["json"]).alias("rescued"))
