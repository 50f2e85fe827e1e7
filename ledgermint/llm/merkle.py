"""Merkle manifest of a data set: one root digest, and for every row a proof that folds to it.

Each row is a leaf. Per source the leaves, in order of their ids, are grouped in runs of `ARITY`; the digest of a run
is a node of the next level, until one is left, the subroot. The subroots, in order of their sources, give the root
in the same way. Every built run is kept as a node row: the digests it holds, and the run and place it goes up to.

The climb is a recursive query over these rows. It starts from every leaf (or from its tampered form), and each step
looks up the run that the digest stands in, appends that run and the place to the row's path, and folds the digest
with its siblings into that of the level above. A path holds references to siblings: rows stay small at every step,
and what a run and all above it contribute to proofs is put together once per run of leaves, not once per leaf.

Ranks within a source come from sorted ranges and their counts, so that a source may hold most rows. Null values are
hashed as `-`. Null ids and sources stand first; rows that tie in source and id go by their digests, equal rows are
equal leaves. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, crc_bucket, materialise, table

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; the trees of sources are numbered from 0.
TOP = -1
#: Runs are numbered within their tree: level times this, plus their number in the level.
LEVEL = 1 << 48
#: Leaves that look up one copy of a run.
FAN_IN = 4096


def leaf_digest(*values: Column) -> Column:
    """H of values: `-` for a null, else its UTF-8 byte count, a colon and the value; integers in decimal."""
    texts = [v.cast("string") for v in values]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*[w.cast("binary") for w in written]), 256)


def run_digest() -> Column:
    """H of the digests of a run."""
    return F.sha2(F.concat_ws("", "children").cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a small table in one part, where its rows are counted.
PART_ROWS = 2000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about `rows` rows, in parts of some `PART_ROWS`; never in more than it has."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def numbered(df: DataFrame, tree: Column, order: list[Column], rows: int) -> tuple[DataFrame, DataFrame]:
    """`df` of `rows` rows, written, with `_pos`, the place from 0 of each row within its tree; and (_tree_of, _n), the sizes of the trees.

    The rows are sorted in ranges and numbered as they lie there; counts per range and tree are all that is summed in order.
    """
    place = F.monotonically_increasing_id()  # of written rows: the range, and the place in it
    ranged = df.withColumn("_tree_of", tree).repartitionByRange(F.col("_tree_of").asc_nulls_first(), *order).sortWithinPartitions(F.col("_tree_of").asc_nulls_first(), *order)
    ranged = materialise(ranged).withColumn("_place", place).withColumn("_range", F.shiftright("_place", 33))
    parts = ranged.groupBy("_tree_of", "_range").agg(F.count("*").alias("_m"), F.min("_place").alias("_first"))
    w = Window.partitionBy("_tree_of").orderBy("_range")
    before = F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(packed(parts.withColumn("_before", before), rows)).select(F.col("_tree_of").alias("_t"), F.col("_range").alias("_r"), "_m", (F.col("_before") - F.col("_first")).alias("_shift"))
    sizes = parts.groupBy(F.col("_t").alias("_tree_of")).agg(F.sum("_m").alias("_n"))
    joined = ranged.join(bounded(parts.drop("_m")), F.col("_tree_of").eqNullSafe(F.col("_t")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_pos", F.col("_place") + F.col("_shift")).drop("_t", "_r", "_range", "_place", "_shift"), sizes


def built_runs(nodes: DataFrame, arity: int, largest: int, rows: int) -> DataFrame:
    """(tree, run, children, up, place, leaves): the runs of all levels over `nodes` (tree, n, pos, digest, leaves).

    `n` is the size of the tree, `largest` the greatest of them, `rows` that of all together; `leaves` counts what
    stands below. `up` is null in the last run of a tree. Trees of one node have no run.
    """
    level, nodes = 0, nodes.where("n > 1")
    columns = ["tree", "run", "children", "up", "place", "leaves"]
    runs = nodes.sparkSession.createDataFrame([], "tree bigint, run bigint, children array<string>, up bigint, place int, leaves bigint").coalesce(1)
    while largest > 1:
        grouped = nodes.groupBy("tree", "n", F.expr(f"pos div {arity}").alias("nth")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("children"), F.sum("leaves").alias("leaves"))
        more = F.col("n") > arity
        run = materialise(packed(grouped.withColumns({"run": F.col("nth") + level * LEVEL, "up": F.when(more, F.expr(f"nth div {arity}") + (level + 1) * LEVEL), "place": F.when(more, F.expr(f"nth % {arity}").cast("int"))}), rows // arity))
        runs = runs.unionByName(run.select(*columns))
        nodes = run.where(more).select("tree", F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.col("nth").alias("pos"), run_digest().alias("digest"), "leaves")
        level, largest, rows = level + 1, -(-largest // arity), rows // arity
    return runs


def _others(children: Column, place: Column) -> Column:
    """The siblings of a place, one after the other."""
    return F.concat_ws("", F.filter(children, lambda x, i: i != place))


def merkle_manifest(docs: DataFrame, source: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, arity: int = ARITY) -> dict[str, DataFrame]:
    """The manifest of `docs`: `leaves` (row, key, leaf, tampered, subroot, root, and the run and place it goes up to) and `runs` (tree, run, copy, children, and the run and place it goes up to).

    `fields` are hashed in order; `tampered` holds expressions for some of them, from which the digests `tampered` are made.
    A run below which many leaves stand is kept in copies, so that the leaves that look it up are spread over tasks.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    other = leaf_digest(*[(tampered or {}).get(f, F.col(f)) for f in fields])
    digests = materialise(docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), leaf.alias("leaf"), other.alias("tampered")))
    total = digests.count()
    rows, sizes = numbered(digests, F.col("_source"), [F.col("_key").asc_nulls_first(), F.col("leaf")], total)
    many_sources = sizes.count()
    sources, _ = numbered(sizes.withColumnRenamed("_tree_of", "_s"), F.lit(0), [F.col("_s").asc_nulls_first()], many_sources)
    sources = materialise(packed(sources.select("_s", F.col("_pos").alias("tree"), "_n"), many_sources))
    leaves = materialise(rows.join(bounded(sources, many_sources), F.col("_tree_of").eqNullSafe(F.col("_s"))).drop("_s", "_source", "_tree_of"))
    largest = sources.agg(F.max("_n")).first()[0] or 0
    below = built_runs(leaves.select("tree", F.col("_n").alias("n"), F.col("_pos").alias("pos"), F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("leaves")), arity, largest, total)
    # the last run of a tree, or its only leaf, gives the subroot
    ends = below.where("up is null").select("tree", run_digest().alias("subroot"), "leaves").unionByName(leaves.where("_n = 1").select("tree", F.col("leaf").alias("subroot"), F.lit(1).cast("long").alias("leaves")))
    subroots = materialise(packed(ends, many_sources))
    above = built_runs(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(many_sources).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"), "leaves"), arity, many_sources, many_sources)
    last = above.where("up is null").select(run_digest().alias("root")).first()
    many = last is not None
    root = last[0] if many else (subroots.select("subroot").first() or [None])[0]
    top = {"up_tree": F.lit(TOP if many else None).cast("long"), "up": F.when(F.lit(many), F.expr(f"tree div {arity}")), "place": F.when(F.lit(many), F.expr(f"tree % {arity}").cast("int"))}
    runs = below.select("tree", "run", "children", "leaves", *[F.when(F.col("up").isNull(), v).otherwise(F.col("tree" if k == "up_tree" else k)).alias(k) for k, v in top.items()])
    runs = runs.unionByName(above.select("tree", "run", "children", "leaves", F.when(F.col("up").isNotNull(), F.col("tree")).alias("up_tree"), "up", "place"))
    copies = F.ceil(F.col("leaves") / FAN_IN).cast("long")
    of_up = bounded(runs.where(F.col("leaves") > FAN_IN).select(F.col("tree").alias("_t"), F.col("run").alias("_r"), copies.alias("up_copies")))  # a row per some thousand leaves
    runs = runs.withColumn("copies", copies).join(of_up, (F.col("up_tree") == F.col("_t")) & (F.col("up") == F.col("_r")), "left").drop("_t", "_r", "leaves")
    runs = materialise(packed(runs.withColumn("up_copies", F.coalesce("up_copies", F.lit(1).cast("long"))).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))), total // arity))
    own = F.col("_n") > 1
    own_up = {"up_tree": F.col("tree"), "up": F.expr(f"_pos div {arity}"), "place": F.expr(f"_pos % {arity}").cast("int")}
    leaves = leaves.select(F.col("_key").alias(key), "leaf", "tampered", "tree", *[F.when(own, v).otherwise(top[k]).alias(k) for k, v in own_up.items()])
    leaves = leaves.join(bounded(subroots.select("tree", "subroot"), many_sources), "tree").drop("tree").withColumn("root", F.lit(root).cast("string"))
    return {"leaves": materialise(leaves).withColumn("row", F.monotonically_increasing_id()), "runs": runs}


#: The climb. A row: the leaf's number, the run and place its digest stands in, the digest folded so far, and the path.
#: A lone leaf of its source stands among few others in a run of subroots, whose first copy it takes.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT row, up_tree, up, place, 0L AS copy, {digest} AS folded,
    cast(array() AS array<struct<tree: bigint, run: bigint, place: int, copies: bigint>>) AS path FROM {{leaves}}
  UNION ALL
  SELECT c.row, r.up_tree, r.up, r.place, pmod(c.row, r.up_copies),
    sha2(concat_ws('', transform(r.children, (x, i) -> if(i = c.place, c.folded, x))), 256),
    array_append(c.path, named_struct('tree', r.tree, 'run', r.run, 'place', c.place, 'copies', r.copies))
  FROM climb c JOIN {{runs}} r ON c.up_tree = r.tree AND c.up = r.run AND c.copy = r.copy)
SELECT row, folded, path FROM climb WHERE up IS NULL
"""


def climbed(manifest: dict[str, DataFrame], digest: str = "tampered") -> DataFrame:
    """(row, folded, path) of every leaf, by the recursive query from the leaves' column `digest`. Each level is one join of the leaves with the runs."""
    spark = manifest["leaves"].sparkSession
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # the limit is meant for endless recursions; this one ends with the height of the trees
    try:
        leaves = manifest["leaves"].select("row", "up_tree", "up", "place", digest)
        return materialise(spark.sql(CLIMB.format(digest=digest), leaves=leaves, runs=manifest["runs"]))
    finally:
        spark.conf.set(name, before)


def proofs(manifest: dict[str, DataFrame], climb: DataFrame) -> DataFrame:
    """(row, folded, proof) of every leaf: the siblings along its path, one after the other.

    What stands above the first run of a path is the same for all its leaves: it is looked up once per such run.
    """
    runs, at = manifest["runs"].select("tree", "run", "copy", "children"), F.get("path", F.lit(0))
    keyed = climb.select("row", "folded", at["tree"].alias("_tree"), at["run"].alias("_run"), at["place"].alias("_place"), F.slice("path", 2, 1 << 20).alias("_above"))
    first = keyed.where("_tree is not null").dropDuplicates(["_tree", "_run"]).select("_tree", "_run", "_above")
    steps = first.select("_tree", "_run", F.posexplode("_above").alias("_nth", "_at")).withColumn("copy", F.pmod(F.xxhash64("_tree", "_run"), F.col("_at.copies")))
    joined = steps.join(runs, (F.col("_at.tree") == F.col("tree")) & (F.col("_at.run") == F.col("run")) & (steps["copy"] == runs["copy"]))
    rest = joined.groupBy("_tree", "_run").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_nth", _others(F.col("children"), F.col("_at.place")).alias("_others")))), lambda x: x["_others"])).alias("_rest"))
    lowest = runs.where("copy = 0").join(first.select("_tree", "_run"), (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run"))).select("_tree", "_run", "children").join(rest, ["_tree", "_run"], "left")
    whole = keyed.drop("_above").join(lowest, ["_tree", "_run"], "left")
    siblings = F.concat(F.coalesce(_others(F.col("children"), F.col("_place")), F.lit("")), F.coalesce("_rest", F.lit("")))
    return whole.select("row", "folded", siblings.alias("proof"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; texts of one in five ids are tampered with."""
    docs = table(spark, sf_dir, "documents")
    touched = {"text": F.when(crc_bucket(F.col("doc_id"), 5) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    manifest = merkle_manifest(docs, tampered=touched)
    found = proofs(manifest, climbed(manifest)).select("row", F.col("folded").alias("folded_root"), F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"))
    leaves = manifest["leaves"].select("row", "doc_id", "leaf", "subroot", "root")
    return leaves.join(found, "row").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of ids bit by bit, and the trees level by level, as the other engine has neither.
ORACLE_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS k, doc_id, source, lang, n_chars, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda acc, y: list_reduce([xor(acc, y)] || range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 5 AS m
  FROM documents),
written AS (SELECT k, doc_id, source, m,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS a, coalesce(strlen(low) || ':' || low, '-') AS b FROM hashed),
leaves AS (SELECT k, doc_id, source, sha256(head || a) AS leaf, sha256(head || CASE WHEN m = 0 THEN b ELSE a END) AS other FROM written),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
below AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT DISTINCT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY tree, level, pos // 16 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 15) // 16 FROM below WHERE n > 1),
subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS n FROM below WHERE n = 1),
above AS (
  SELECT 0 AS level, tree AS pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT DISTINCT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY level, pos // 16 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 15) // 16 FROM above WHERE n > 1),
height AS (SELECT tree, max(level) AS h FROM below GROUP BY tree),
nodes AS (SELECT tree, level, pos, digest, n FROM below UNION ALL SELECT -1, level, pos, digest, n FROM above),
runs AS (SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS children FROM nodes WHERE n > 1 GROUP BY ALL),
steps AS (SELECT p.k, p.tree AS t, x AS level, (p.pos // (16 ** x)::BIGINT) AS spot, x AS nth FROM placed p JOIN height USING (tree), LATERAL unnest(range(h)) u(x)
  UNION ALL SELECT p.k, -1, x, (p.tree // (16 ** x)::BIGINT), h + x FROM placed p JOIN height USING (tree), LATERAL unnest(range((SELECT max(level) FROM above))) u(x)),
siblings AS (SELECT k, nth, children, (spot % 16)::INT AS place FROM steps s JOIN runs r ON r.tree = s.t AND r.level = s.level AND r.run = s.spot // 16),
paths AS (SELECT k, list(struct_pack(before := array_to_string(children[:place], ''), after := array_to_string(children[place + 2:], '')) ORDER BY nth) AS path FROM siblings GROUP BY k),
folds AS (SELECT p.k, coalesce(path, []) AS path, list_reduce([struct_pack(before := other, after := '')] || coalesce(path, []), lambda acc, s: struct_pack(before := sha256(s.before || acc.before || s.after), after := '')).before AS folded_root
  FROM placed p LEFT JOIN paths USING (k))
SELECT doc_id, leaf, subroot, (SELECT digest FROM above WHERE n = 1) AS root, sha256(array_to_string(list_transform(f.path, lambda s: s.before || s.after), '')) AS proof_sha256,
  folded_root, folded_root = (SELECT digest FROM above WHERE n = 1) AS verified
FROM placed p JOIN subroots USING (tree) JOIN folds f ON f.k = p.k
"""
