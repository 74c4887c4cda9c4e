"""A Merkle manifest of a dataset, with leaf places taken from bitmaps.

Every row is a leaf; the leaves of a group (a source) ascend by id; every three consecutive nodes become
their parent until one is left, the group's subroot. The subroots, by group name, make a tree of the same
kind, whose root stands for the dataset. A leaf's siblings on its way to the root prove that it belongs to
it.

* **Places without a sort of the leaves.** The ids of a group are bits of 64-bit words; tasks merge their
  words with ``bit_or`` and only words with a bit exist. A directory adds up the rows of words, of 1,024
  words, of 1,024 such blocks and so on, as far as the ids reach; a leaf's place is what the directory has
  before its word plus the bits below its own. Ids that several rows share carry their counts beside the
  word.
* **Levels in slots.** A leaf goes to the block of 729 places its own belongs to, as one slot of an array,
  and six levels are made of that array at once. The roots of the blocks are the slots of the next pass, so
  the shuffles are as many as the number of leaves has digits to the base 729, each a 729th of the one before.
* **Paths from above.** Paths of blocks are put together from the root downwards and joined to the blocks
  below by their number, so a leaf's way is complete in its block and only its hash and folded root leave it.

No group, however large, meets in one task: words, directory blocks and slot arrays are bounded, and rows that
are equal in everything are counted inside tasks and given out again by their number. Rows with one id and
different contents are ordered by their leaf hash, in up to 4,096 shares by its first digits.

Defined cases: a null id stands before all others and is never tampered with; a null group stands first;
equal rows take places beside each other; an empty table gives no rows; further columns are ignored. Ids are
integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteratio.llm.store import stored

#: Children of a node, levels made at once, and slots of a block.
ARITY, DEPTH = 3, 6
WIDTH = ARITY**DEPTH
#: Bits of a directory step: a block has 1,024 children.
STEP = 10
#: Names put into one ordered range while groups are numbered.
RANGE_ROWS = 100_000
#: Copies of one row that are given out by one row of the plan.
COPIES = 4096


def field_hash(*fields: Column) -> Column:
    """SHA-256 (hex) of fields in a row, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    text = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    return F.sha2(F.concat(*[F.coalesce(t, F.lit("-")) for t in text]), 256)


def group_key(group: str) -> Column:
    """A name that is never null and sorts as the groups do, the null group first."""
    return F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))


# ---------------------------------------------------------------- places


def _words(leaves: DataFrame, first: int) -> DataFrame:
    """Add the word of an id (counted from the first; null ids have word 0) and its bit there."""
    null = F.col("id").isNull()
    return leaves.withColumn(
        "word", F.when(null, F.lit(0)).otherwise(F.shiftright("id", 6) - F.lit(first) + 1).cast("long")
    ).withColumn("bit", F.when(null, F.lit(0)).otherwise(F.col("id").bitwiseAND(63)).cast("int"))


def _directory(words: DataFrame, span: int) -> DataFrame:
    """g, word, bits, shared and ``base``: the rows of the group in earlier words."""
    levels = [words.select("g", F.col("word").alias("node"), "rows")]
    while span >> (STEP * len(levels)):
        up = levels[-1].select("g", F.shiftright("node", STEP).alias("node"), "rows")
        levels.append(up.groupBy("g", "node").agg(F.sum("rows").alias("rows")))
    base = None
    for level in reversed(levels):
        # at most 1,024 children of one node
        here = level.selectExpr(
            "g",
            "node",
            f"shiftright(node, {STEP}) AS parent",
            f"coalesce(sum(rows) OVER (PARTITION BY g, shiftright(node, {STEP}) ORDER BY node"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before",
        )
        if base is not None:
            above = base.select("g", F.col("node").alias("parent"), "base")
            here = here.join(above, ["g", "parent"]).withColumn("before", F.expr("before + base"))
        base = here.select("g", "node", F.col("before").alias("base"))
    return words.join(base.withColumnRenamed("node", "word"), ["g", "word"])


def _within_id(leaves: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of one id that stand before a leaf of the same id, where an id has several leaves."""
    some = leaves.join(ids.where("leaves > 1").select("g", "word", "bit"), ["g", "word", "bit"])
    some = some.withColumn("share", F.substring("leaf", 1, 3))
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    shares = some.groupBy("g", "word", "bit", "share").agg(F.sum("copies").alias("rows"))
    shares = shares.selectExpr(
        "g",
        "word",
        "bit",
        "share",
        f"coalesce(sum(rows) OVER (PARTITION BY g, word, bit ORDER BY share {earlier}), 0L) AS before",
    )
    here = f"coalesce(sum(copies) OVER (PARTITION BY g, word, bit, share ORDER BY leaf {earlier}), 0L)"
    return (
        some.selectExpr("g", "word", "bit", "share", "leaf", f"{here} AS inside")
        .join(shares, ["g", "word", "bit", "share"])
        .selectExpr("g", "word", "bit", "leaf", "before + inside AS inside")
    )


def places(leaves: DataFrame) -> DataFrame:
    """Rows g, id, leaf, changed with their place ``i`` among the ``n`` rows of their group.

    ``leaves`` has g (not null), id, leaf and changed. Equal rows are counted first, so a row that very many
    rows repeat is one row until its places are given out.
    """
    leaves = stored(leaves.groupBy("g", "id", "leaf", "changed").agg(F.count("*").alias("copies")), "leaves")
    low, high = leaves.agg(F.min("id"), F.max("id")).first()
    first, span = (0, 1) if low is None else (low >> 6, (high >> 6) - (low >> 6) + 1)
    leaves = _words(leaves, first)
    ids = leaves.groupBy("g", "word", "bit").agg(F.sum("copies").alias("rows"), F.count("*").alias("leaves"))
    shared = F.when(F.col("rows") > 1, F.struct("bit", (F.col("rows") - 1).alias("more")))
    words = ids.groupBy("g", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"),
        F.sum("rows").alias("rows"),
        F.collect_list(shared).alias("shared"),
    )
    words = stored(words, "bitmaps")
    sizes = words.groupBy("g").agg(F.sum("rows").alias("n"))
    directory = _directory(words, span).join(sizes, "g").drop("rows")
    keys = ["g", "word", "bit", "leaf"]
    start = (
        "base + bit_count(bits & ~shiftleft(-1L, bit))"
        " + aggregate(shared, 0L, (a, s) -> a + if(s.bit < bit, s.more, 0L)) + coalesce(inside, 0L)"
    )
    found = (
        leaves.join(_within_id(leaves, ids), keys, "left")
        .join(directory, ["g", "word"])
        .selectExpr("g", "id", "leaf", "changed", "n", "copies", f"{start} AS i")
    )
    once = found.where("copies = 1")
    parts = found.where("copies > 1").selectExpr("*", f"explode(sequence(0L, copies - 1, {COPIES}L)) AS part")
    again = parts.repartition("g", "i", "part").selectExpr(
        "g", "id", "leaf", "changed", "n", f"explode(sequence(i + part, i + least(part + {COPIES}, copies) - 1)) AS i"
    )
    return once.drop("copies").unionByName(again)


# ---------------------------------------------------------------- levels


def _levels_made() -> str:
    """Levels a block makes: six, or as many as a group of up to 729 nodes needs."""
    steps = "".join(f" WHEN n <= {ARITY**d} THEN {d}" for d in range(DEPTH))
    return f"CASE{steps} ELSE {DEPTH} END"


def _block_levels() -> str:
    """All levels of a block, its slots first, as an array of arrays."""
    parents = (
        f"transform(sequence(0, (size(a) - 1) div {ARITY}), "
        f"r -> sha2(array_join(slice(a, cast(r * {ARITY} + 1 AS int), {ARITY}), ''), 256))"
    )
    nodes = parents.replace("(a)", "(element_at(acc, -1))").replace("(a,", "(element_at(acc, -1),")
    kind = "array<array<string>>"
    return (
        f"aggregate(slice(sequence(1, {DEPTH}), 1, depth), cast(array(slots.digest) AS {kind}),"
        f" (acc, k) -> cast(concat(acc, array({nodes})) AS {kind}))"
    )


def _own_path(j: str) -> str:
    """What stands left and right of slot ``j``'s node on every level of its block."""
    place = f"({j} div element_at(array({', '.join(str(ARITY**d) for d in range(DEPTH))}), k + 1))"
    level = "element_at(levels, k + 1)"
    side = lambda start, count: f"array_join(slice({level}, cast({start} AS int), cast({count} AS int)), '')"
    left = side(f"{place} - {place} % {ARITY} + 1", f"{place} % {ARITY}")
    right = side(f"{place} + 2", f"{ARITY - 1} - {place} % {ARITY}")
    return (
        f"transform(slice(sequence(0, {DEPTH - 1}), 1, depth), k -> named_struct('left', {left}, 'right', {right}))"
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """g, block, n, depth, slots, levels and root from nodes (g, i, n, digest and any more columns)."""
    slot = F.struct("i", *[c for c in nodes.columns if c not in ("g", "i", "n")])
    return (
        nodes.groupBy("g", F.expr(f"i div {WIDTH}").alias("block"))
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(slot)).alias("slots"))
        .selectExpr("*", f"{_levels_made()} AS depth")
        .selectExpr("*", f"{_block_levels()} AS levels")
        .selectExpr("*", "element_at(levels, -1)[0] AS root")
    )


@dataclass(frozen=True)
class Forest:
    """The blocks of every pass, for all groups."""

    passes: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """g and digest: the last node of every group."""
        done = [b.where(f"n <= {WIDTH}").select("g", F.col("root").alias("digest")) for b in self.passes]
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def tails(self, top: DataFrame) -> DataFrame:
        """The lowest blocks with ``subroot`` and the ``tail`` of a path from the block's root on.

        ``top`` has g, subroot and the path above it.
        """
        above, out = None, None
        for b in reversed(self.passes):
            # a group's last block is one row, so neither join meets a large key
            out = b.where(f"n <= {WIDTH}").join(top.withColumnRenamed("path", "tail"), "g")
            if above is not None:
                out = out.unionByName(b.where(f"n > {WIDTH}").join(above, ["g", "block"]))
            above = out.selectExpr(
                "g",
                "subroot",
                f"inline(transform(slots, (x, j) -> named_struct('block', x.i, 'tail', concat({_own_path('j')}, tail))))",
            )
        return out


def grow(nodes: DataFrame, name: str) -> Forest:
    """Make all levels of the trees of ``nodes`` (g, i, n, digest), one tree a group."""
    passes = []
    while True:
        blocks = stored(_blocks(nodes), name)
        passes.append(blocks)
        more = blocks.where(f"n > {WIDTH}")
        if more.isEmpty():
            return Forest(passes)
        nodes = more.selectExpr(
            "g", "block AS i", f"(n + {WIDTH - 1}) div {WIDTH} AS n", "root AS digest"
        )


def _numbered(names: DataFrame) -> DataFrame:
    """Rows with a place ``i`` in the order of g and their number ``n``, in ranges of bounded size."""
    names = stored(names, "subroots")
    n = names.count()
    cut = names.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "g").withColumn("range", F.spark_partition_id())
    cut = stored(cut, "ranges")
    before = cut.groupBy("range").agg(F.count("*").alias("rows")).selectExpr(
        "range",
        "coalesce(sum(rows) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before",
    )
    inside = cut.selectExpr("*", "row_number() OVER (PARTITION BY range ORDER BY g) - 1L AS inside")
    return inside.join(before, "range").selectExpr("g", "digest", "before + inside AS i", f"{n}L AS n")


# ---------------------------------------------------------------- the manifest


def manifest(leaves: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``leaves`` has group (any text or null), id, leaf, and ``changed``: the leaf of a row as it is found
    later, or null where it is as it was. A changed leaf is folded with the siblings of the untouched tree.
    """
    named = leaves.select(group_key("group").alias("g"), F.col("id").cast("long").alias("id"), "leaf", "changed")
    forest = grow(places(named).withColumnRenamed("leaf", "digest"), "blocks")
    subroots = _numbered(forest.roots)
    over = grow(subroots.select(F.lit("").alias("g"), "i", "n", "digest", F.col("g").alias("name")), "top")
    root = over.roots.first()
    # the top tree ends in the root: nothing stands above it
    ends = over.roots.selectExpr(
        "g", "digest AS subroot", "cast(array() AS array<struct<left: string, right: string>>) AS path"
    )
    top = over.tails(ends).selectExpr(
        f"inline(transform(slots, (x, j) -> named_struct('g', x.name, 'subroot', x.digest,"
        f" 'path', concat({_own_path('j')}, tail))))"
    )
    ways = forest.tails(top).selectExpr(
        "subroot",
        "transform(slots, (x, j) -> named_struct('id', x.id, 'leaf', x.digest, 'now', coalesce(x.changed, x.digest),"
        f" 'path', concat({_own_path('j')}, tail))) AS rows",
    )
    proof = "sha2(array_join(transform(x.path, s -> concat(s.left, s.right)), ''), 256)"
    folded = "aggregate(x.path, x.now, (a, s) -> sha2(concat(s.left, a, s.right), 256))"
    return (
        ways.selectExpr(
            "subroot",
            f"inline(transform(rows, x -> named_struct('id', x.id, 'leaf', x.leaf, 'proof_sha256', {proof},"
            f" 'folded_root', {folded})))",
        )
        .withColumn("root", F.lit(root.digest if root else None).cast("string"))
        .withColumn("verified", F.expr("folded_root = root"))
        .select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    )


def document_leaves(docs: DataFrame, later: Column | None = None) -> DataFrame:
    """group, id, leaf and changed of documents; ``later`` is the text as it is found later (default: as it was)."""
    text = F.col("text").cast("string")
    hashed = lambda t: field_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    changed = F.lit(None).cast("string") if later is None else F.when(later != text, hashed(later))
    return docs.select(
        F.col("source").alias("group"), F.col("doc_id").alias("id"), hashed(text).alias("leaf"), changed.alias("changed")
    )


def without_newlines(text: str = "text", key: str = "doc_id", every: int = 2) -> Column:
    """The text, its line feeds deleted in rows whose id has a CRC-32 that ``every`` divides."""
    hit = F.crc32(F.col(key).cast("string")) % every == 0
    return F.when(hit, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
