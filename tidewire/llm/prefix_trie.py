"""Conversation prefix trie: a z-fast trie kept in tables.

A conversation is a sequence of turns. Its prefix of depth d has a fingerprint of 128 bits, the XOR of its turns' hashes, each taken
with the turn's place; so a prefix is known by (d, fingerprint) wherever it is looked up. Fingerprints travel in blocks of BLOCK depths: no row grows
with the length of a conversation.

The trie is compacted: a node stands where conversations part or end, and the edge above it spans the depths (q, e]. In (q, e] the
two-fattest number f (the one with most zero bits at its end) is the node's handle depth, and the trie is a table of nodes by
(f, fingerprint at f). A conversation finds its exit node by fat binary search: it looks up its own fingerprint at the two-fattest depth of
(a, b]; a hit moves a to the node's end, a miss moves b below f. A last look at the first turn past the node, and a comparison of
fingerprints along the edge, give the depth at which the conversation leaves the trie.

Conversations are inserted in batches. All that are not in yet are located; of those that leave at the same depth with the same turn,
the one with the smallest hash goes in (a pseudo-random one, so the number of batches is about the logarithm of the
conversations), edges are split at all the depths where they are left, and the others start their next search from there. Counts are summed up
the compacted tree by pointer doubling, and at last the edges are expanded to a row for every depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Depths whose fingerprints are one row (16 bytes each).
BLOCK = 1024
#: Steps of the search that make one plan.
STEPS = 4
#: Bytes of conversation numbers that are one row on the way to a digest.
CHUNK = 1 << 16
#: First turns from the base conversation: a base for every GROUP numbers, up to SHARED - 1 turns.
GROUP, SHARED = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"


# ---- turns -------------------------------------------------------------------------------------------------------------------------


def ordered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), key, words. Turns are numbered by ranges of (conversation, turn), so one huge conversation is many tasks."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    rows = turns.select(F.col("`conv_id`").cast("long").alias("conv"), F.col("`turn`").alias("turn"), key.alias("key"), F.size(F.regexp_extract_all(text("text"), F.lit(WORDS), F.lit(0))).cast("long").alias("words")).where(F.col("conv").isNotNull())
    order = [F.asc_nulls_first("turn"), F.col("key")]
    rows = materialise(rows.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0")  # few: conversations cut by a range
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return rows.withColumn("nth", place).join(counts.select("conv", "part", "before"), ["conv", "part"], "left").select("conv", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, d, key, words) and (conv, n): the first h turns of the base conversation, then the own turns after the first h."""
    rows = materialise(ordered(turns), "trie-ordered")
    convs = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % GROUP).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED)
    bases = convs.where(F.col("conv") == F.col("base")).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialise(convs.select("conv", "base", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "trie-convs")
    first = rows.where((F.col("conv") % GROUP == 0) & (F.col("pos") < SHARED)).select(F.col("conv").alias("base"), F.col("pos").alias("d"), "key", "words")
    lent = convs.where("lent > 0").select("conv", "base", "lent").join(first, "base").where(F.col("d") <= F.col("lent")).select("conv", "d", "key", "words")
    own = rows.join(convs.select("conv", "h", "lent"), "conv").where(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("d"), "key", "words")
    return lent.unionByName(own), convs.select("conv", "n")


# ---- fingerprints ------------------------------------------------------------------------------------------------------------------


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv, blk, p (fingerprints), w (words up to there), for each BLOCK depths."""
    rows = turns.withColumn("blk", F.floor((F.col("d") - 1) / BLOCK)).withColumns({"k1": F.xxhash64("key", "d"), "k2": F.xxhash64(F.lit("second"), "d", "key")})
    inside = Window.partitionBy("conv", "blk").orderBy("d")
    rows = rows.withColumns({"p1": F.bit_xor("k1").over(inside), "p2": F.bit_xor("k2").over(inside), "w": F.sum("words").over(inside)})
    blocks = rows.groupBy("conv", "blk").agg(F.sort_array(F.collect_list(F.struct("d", "p1", "p2", "w"))).alias("rows"), F.bit_xor("k1").alias("t1"), F.bit_xor("k2").alias("t2"), F.sum("words").alias("tw"))
    earlier = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK turns
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.withColumns({"b1": zero(F.bit_xor("t1").over(earlier)), "b2": zero(F.bit_xor("t2").over(earlier)), "bw": zero(F.sum("tw").over(earlier))})
    p = F.transform("rows", lambda r: F.struct(r["p1"].bitwiseXOR(F.col("b1")).alias("p1"), r["p2"].bitwiseXOR(F.col("b2")).alias("p2")))
    return blocks.select("conv", "blk", p.alias("p"), F.transform("rows", lambda r: r["w"] + F.col("bw")).alias("w"))


def look_up(rows: DataFrame, blocks: DataFrame, seq: str, depth: Column, one: str, two: str, words: str | None = None) -> DataFrame:
    """The fingerprint (and words) of a row's sequence at a depth as new columns; zeros at depth 0, null where the depth is null."""
    found = blocks.select(F.col("s").alias("_s"), F.col("blk").alias("_blk"), F.col("p").alias("_p"), *([F.col("w").alias("_w")] if words else []))
    rows = rows.withColumn("_d", depth)
    joined = rows.join(found, (F.col(seq) == F.col("_s")) & (F.floor((F.col("_d") - 1) / BLOCK) == F.col("_blk")), "left")
    at = ((F.col("_d") - 1) % BLOCK).cast("int")
    pick = lambda c: F.when(F.col("_d") == 0, F.lit(0).cast("long")).when(F.col("_d") > 0, c)
    new = {one: pick(F.get("_p", at)["p1"]), two: pick(F.get("_p", at)["p2"])} | ({words: pick(F.get("_w", at))} if words else {})
    return joined.withColumns(new).drop("_d", "_s", "_blk", "_p", "_w")


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with most zero bits at its end."""
    shift = (F.length(F.bin(a.bitwiseXOR(b))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", b, shift), shift)


# ---- the trie ----------------------------------------------------------------------------------------------------------------------

_NODE = ["e", "x1", "x2", "q", "rep", "f", "f1", "f2", "c1", "c2"]


def with_handles(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """From e, x1, x2, q, rep: the handle (f, f1, f2) and the fingerprint of the first turn of the edge (c1, c2)."""
    nodes = nodes.withColumn("f", fattest(F.col("q"), F.col("e")))
    return look_up(look_up(nodes, blocks, "rep", F.col("f"), "f1", "f2"), blocks, "rep", F.col("q") + 1, "c1", "c2").select(*_NODE)


def search(rows: DataFrame, nodes: DataFrame, blocks: DataFrame, widest: int) -> DataFrame:
    """Fat binary search. rows: s, n, z1, z2, a and the node that ends at a (e, x1, x2, q, rep); the last hit replaces the node."""
    found = nodes.select(*[F.col(c).alias(f"n_{c}") for c in ("e", "x1", "x2", "q", "rep", "f", "f1", "f2")])
    rows = rows.withColumn("b", F.col("n"))
    for step in range(widest.bit_length()):
        rows = rows.withColumn("at", F.when(F.col("a") < F.col("b"), fattest(F.col("a"), F.col("b"))))
        rows = look_up(rows, blocks, "s", F.col("at"), "h1", "h2")
        rows = rows.join(found, (F.col("at") == F.col("n_f")) & (F.col("h1") == F.col("n_f1")) & (F.col("h2") == F.col("n_f2")), "left")
        hit = F.col("n_f").isNotNull()
        moved = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("e", "x1", "x2", "q", "rep")}
        moved |= {"a": F.when(hit, F.col("n_e")).otherwise(F.col("a")), "b": F.when(~hit & F.col("at").isNotNull(), F.col("at") - 1).otherwise(F.col("b"))}
        rows = rows.withColumns(moved).drop("at", "h1", "h2", *found.columns)
        if step % STEPS == STEPS - 1:
            rows = materialise(rows, "trie-search")
    return rows.drop("b")


def located(rows: DataFrame, nodes: DataFrame, blocks: DataFrame, widest: int) -> DataFrame:
    """Each sequence with its exit node and `lcp`, the depth up to which they agree; g1, g2 and l1, l2: fingerprints just past and at that depth."""
    rows = look_up(search(rows, nodes, blocks, widest), blocks, "s", F.when(F.col("e") < F.col("n"), F.col("e") + 1), "h1", "h2").withColumn("next", F.col("e") + 1)
    child = nodes.select((F.col("q") + 1).alias("n_d"), *[F.col(c).alias(f"n_{c}") for c in ("e", "x1", "x2", "q", "rep", "c1", "c2")])
    rows = rows.join(child, (F.col("next") == F.col("n_d")) & (F.col("h1") == F.col("n_c1")) & (F.col("h2") == F.col("n_c2")), "left")
    rows = rows.withColumns({c: F.when(F.col("n_d").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("e", "x1", "x2", "q", "rep")})
    rows = rows.select("s", "n", "z1", "z2", "e", "x1", "x2", "q", "rep", F.least("n", "e").alias("upto"))
    # block by block along the edge; equal fingerprints mean that all turns up to there are equal
    spans = F.when(F.col("upto") > F.col("q"), F.sequence(F.floor(F.greatest(F.lit(0), F.col("q")) / BLOCK), F.floor((F.greatest(F.lit(1), F.col("upto")) - 1) / BLOCK)))
    mine, theirs = (blocks.select(F.col("s").alias(f"{n}s"), F.col("blk").alias(f"{n}b"), F.col("p").alias(f"{n}p")) for n in ("m", "t"))
    each = rows.withColumn("blk", F.explode_outer(F.when(F.col("rep").isNotNull(), spans)))
    each = each.join(mine, (F.col("s") == F.col("ms")) & (F.col("blk") == F.col("mb")), "left").join(theirs, (F.col("rep") == F.col("ts")) & (F.col("blk") == F.col("tb")), "left")
    same = F.size(F.filter(F.zip_with("mp", "tp", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    upto = F.when(same > 0, F.least(F.col("blk") * BLOCK + same, F.col("upto")))
    rows = each.groupBy(*rows.columns).agg(F.coalesce(F.max(upto), F.lit(0).cast("long")).alias("lcp")).drop("upto")
    rows = look_up(rows, blocks, "s", F.when(F.col("lcp") < F.col("n"), F.col("lcp") + 1), "g1", "g2")
    return look_up(rows, blocks, "s", F.col("lcp"), "l1", "l2")


def build(seqs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The compacted nodes but the root. seqs: s, n, z1, z2, all different; blocks: theirs."""
    spark = seqs.sparkSession
    nodes = spark.createDataFrame([], "e long, x1 long, x2 long, q long, rep long, f long, f1 long, f2 long, c1 long, c2 long")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    pending = seqs.where("n > 0").select("s", "n", "z1", "z2", zero.alias("a"), zero.alias("e"), zero.alias("x1"), zero.alias("x2"), F.lit(-1).cast("long").alias("q"), none.alias("rep"))
    empty = True
    while True:
        left = pending.agg(F.count(F.lit(1)), F.max(F.col("n") - F.col("a"))).first()
        if not left[0]:
            return nodes
        rows = materialise(located(pending, nodes, blocks, 0 if empty else max(0, left[1])), "trie-located")
        past = rows.where("lcp < n")
        group = ["e", "x1", "x2", "lcp", "g1", "g2"]
        chosen = past.groupBy(*group).agg(F.min(F.struct(F.xxhash64("s").alias("h"), "s", "n", "z1", "z2")).alias("c"))
        chosen = materialise(chosen.select("lcp", "c.*"), "trie-chosen")
        cuts = rows.where("lcp < e").groupBy("e", "x1", "x2", "q", "rep", "lcp").agg(F.first("l1").alias("l1"), F.first("l2").alias("l2"))
        cuts = materialise(cuts.withColumn("above", F.coalesce(F.lag("lcp").over(Window.partitionBy("e", "x1", "x2").orderBy("lcp")), F.col("q"))), "trie-cuts")
        leaves = chosen.select(F.col("n").alias("e"), F.col("z1").alias("x1"), F.col("z2").alias("x2"), F.col("lcp").alias("q"), F.col("s").alias("rep"))
        inner = cuts.select(F.col("lcp").alias("e"), F.col("l1").alias("x1"), F.col("l2").alias("x2"), F.col("above").alias("q"), "rep")
        lowest = cuts.groupBy("e", "x1", "x2").agg(F.max("lcp").alias("cut"))
        kept = nodes.join(lowest, ["e", "x1", "x2"], "left")
        moved = kept.where("cut is not null").select("e", "x1", "x2", F.col("cut").alias("q"), "rep")
        fresh = with_handles(leaves.unionByName(inner).unionByName(moved), blocks)
        nodes = materialise(kept.where("cut is null").select(*_NODE).unionByName(fresh), "trie-nodes")
        # the next search starts at the node where the sequence left: it ends at lcp now
        again = past.join(chosen.select("s"), "s", "left_anti")
        there = F.col("lcp") == F.col("e")
        again = again.withColumns({"x1": F.col("l1"), "x2": F.col("l2"), "q": F.when(there, F.col("q")).otherwise(F.col("lcp") - 1), "e": F.col("lcp"), "a": F.col("lcp")})
        pending = materialise(again.select("s", "n", "z1", "z2", "a", "e", "x1", "x2", "q", "rep"), "trie-pending")
        empty = False


def summed(nodes: DataFrame) -> DataFrame:
    """Totals over each node's subtree by pointer doubling. nodes: id, up (null at the root), least (null without ends) and counts."""
    counts = ["copies", "ended", "edges", "leaves"]
    nodes = nodes.withColumn("jump", F.col("up"))
    while nodes.where("jump is not null").limit(1).count():
        below = nodes.where("jump is not null").groupBy(F.col("jump").alias("_of")).agg(F.min("least").alias("_least"), *[F.sum(c).alias(f"_{c}") for c in counts])
        jumps = nodes.where("jump is not null").select(F.col("id").alias("_to"), F.col("jump").alias("_jump"))
        nodes = nodes.join(below, F.col("id") == F.col("_of"), "left").join(jumps, F.col("jump") == F.col("_to"), "left")
        more = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in counts} | {"least": F.least("least", "_least"), "jump": F.col("_jump")}
        nodes = materialise(nodes.withColumns(more).drop("_of", "_least", "_to", "_jump", *[f"_{c}" for c in counts]), "trie-sums")
    return nodes.drop("jump")


def end_digests(members: DataFrame) -> DataFrame:
    """id and the SHA-256 of its conversations' numbers in order, comma-joined. Numbers are joined in ranges, a digest takes the pieces in
    order, one at a time: constant memory for any number of copies."""
    import hashlib

    def pieces(batches):
        import pyarrow as pa

        node, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for of, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (of != node or size > CHUNK):
                    out.append((node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = of, c
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["id", "first", "piece"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["id", "first", "piece"])

    def digests(batches):
        import pyarrow as pa

        node, state = None, None
        for batch in batches:
            out = []
            for of, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of != node or state is None:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = of, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["id", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    ranged = members.select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
    joined = ranged.mapInArrow(pieces, "id long, first long, piece string").repartition("id").sortWithinPartitions("id", "first")
    return joined.select("id", "piece").mapInArrow(digests, "id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every distinct prefix. turns: conv, d (gapless from 1), key, words; convs: conv, n, those without turns included."""
    whole = materialise(blocks_of(turns), "trie-blocks")
    last = look_up(convs.select("conv", "n"), whole.withColumnRenamed("conv", "s"), "conv", F.col("n"), "z1", "z2", "w")
    last = materialise(last, "trie-ends")
    seqs = materialise(last.groupBy("n", "z1", "z2").agg(F.min("conv").alias("s"), F.count(F.lit(1)).alias("copies"), F.first("w").alias("w")), "trie-seqs")
    blocks = materialise(whole.withColumnRenamed("conv", "s").join(seqs.select("s"), "s", "left_semi"), "trie-reps")
    compact = build(seqs.select("s", "n", "z1", "z2"), blocks)

    one, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    below = look_up(compact.select("e", "x1", "x2", "q", "rep"), blocks, "rep", F.col("q"), "y1", "y2", "wq")
    below = look_up(below, blocks, "rep", F.col("e"), "_1", "_2", "we").drop("_1", "_2")
    root = convs.agg(F.count(F.lit(1)).alias("c")).where("c > 0").select(one.alias("e"), one.alias("x1"), one.alias("x2"), none.alias("q"), none.alias("rep"), none.alias("y1"), none.alias("y2"), one.alias("wq"), one.alias("we"))
    nodes = materialise(below.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "trie-numbered")
    ups = nodes.select(F.col("id").alias("up"), F.col("e").alias("_e"), F.col("x1").alias("_1"), F.col("x2").alias("_2"))
    nodes = nodes.join(ups, (F.col("q") == F.col("_e")) & (F.col("y1") == F.col("_1")) & (F.col("y2") == F.col("_2")), "left").drop("_e", "_1", "_2")
    ends = seqs.select(F.col("n").alias("e"), F.col("z1").alias("x1"), F.col("z2").alias("x2"), F.col("s").alias("least"), "copies", (F.col("copies") * F.col("w")).alias("ended"))
    nodes = materialise(nodes.join(ends, ["e", "x1", "x2"], "left"), "trie-linked")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, "id", "left").fillna(0, ["copies", "ended", "kids"])
    nodes = nodes.withColumns({"edges": F.col("we") - F.col("wq"), "leaves": (F.col("kids") == 0).cast("long")})
    nodes = summed(materialise(nodes, "trie-own"))
    members = last.select("conv", F.col("n").alias("e"), F.col("z1").alias("x1"), F.col("z2").alias("x2")).join(nodes.select("id", "e", "x1", "x2"), ["e", "x1", "x2"])
    digests = materialise(end_digests(members), "trie-digests")
    parents = nodes.select(F.col("id").alias("up"), F.col("least").alias("parent"))
    nodes = materialise(nodes.join(parents, "up", "left").join(digests, "id", "left"), "trie-whole")

    # a row for every depth of an edge, from the blocks that it runs through
    blank = F.sha2(F.lit(""), 256)
    edge = nodes.where("q is not null").withColumn("blk", F.explode(F.sequence(F.floor(F.col("q") / BLOCK), F.floor((F.col("e") - 1) / BLOCK))))
    edge = edge.join(blocks.select(F.col("s").alias("_s"), F.col("blk").alias("_b"), "w"), (F.col("rep") == F.col("_s")) & (F.col("blk") == F.col("_b")))
    start, stop = F.greatest(F.col("q") + 1, F.col("blk") * BLOCK + 1), F.least(F.col("e"), (F.col("blk") + 1) * BLOCK)
    depth = edge.withColumn("d", F.explode(F.sequence(start, stop))).withColumn("at", ((F.col("d") - 1) % BLOCK).cast("int"))
    # words before the depth's own turn: inside a block from the block, at its start from the words up to there less the turn's
    return _told(depth, blocks, blank).unionByName(nodes.where("q is null").select(F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("ended") - F.col("edges")).alias("saved_tokens"), F.coalesce("ends_sha256", blank).alias("ends_sha256")))


def _told(rows: DataFrame, blocks: DataFrame, blank: Column) -> DataFrame:
    """The rows of the edges' depths. Saved in a subtree: for each conversation the words from here to its end, once for each distinct node less."""
    last = blocks.select(F.col("s").alias("_ls"), (F.col("blk") + 1).alias("_lb"), F.element_at("w", -1).alias("_lw"))
    first = rows.where("at = 0").join(last, (F.col("rep") == F.col("_ls")) & (F.col("blk") == F.col("_lb")), "left").withColumn("before", F.coalesce("_lw", F.lit(0).cast("long"))).drop("_ls", "_lb", "_lw")
    rows = rows.where("at > 0").withColumn("before", F.get("w", F.col("at") - 1)).unionByName(first)
    end, top = F.col("d") == F.col("e"), F.col("d") == F.col("q") + 1
    saved = (F.col("ended") - F.col("copies") * F.col("before")) - (F.col("edges") - (F.col("before") - F.col("wq")))
    return rows.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("copies").alias("n_convs"),
        F.when(end, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.when(end, F.coalesce("ends_sha256", blank)).otherwise(blank).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for every distinct prefix of the
    rebuilt conversations, from the root.

    Null roles and texts are empty; turns without a conv_id belong to no conversation. Null turns come first; equal turns of a conversation go by the MD5 of role and
    text, repeated rows are turns of their own. A conversation may have any number of turns and a text any length. An empty table gives no
    rows. Other columns, whatever their names, are not read. Prefixes are told apart by 128 bits.
    """
    return prefix_trie(*rebuilt(turns))


def sql() -> str:
    """The same in DuckDB SQL: prefixes as strings of digests, counted over all their conversations. The base gives up to SHARED - 1 turns."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
    return rf"""WITH k AS (SELECT {table} AS tab),
    t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos, key, words FROM
      (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
    c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t), k),
    r AS MATERIALIZED (SELECT c.conv_id, key, words, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, pos) AS d FROM
      (SELECT c.conv_id, 0 AS own, pos, key, words FROM c JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, key, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h) c),
    p AS MATERIALIZED (SELECT conv_id, d, string_agg(key, '') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY d) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    e AS (SELECT conv_id, max(d) AS n FROM p GROUP BY 1),
    n AS MATERIALIZED (SELECT path, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (n = d) AS ends FROM p JOIN e USING (conv_id) GROUP BY 1, 2),
    u AS MATERIALIZED (SELECT *, left(path, greatest(0, len(path) - 32)) AS up FROM n),
    kids AS (SELECT up, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1),
    s AS (SELECT a.path, count(*) FILTER (kids.up IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved FROM u b LEFT JOIN kids ON kids.up = b.path JOIN p m ON m.conv_id = b.conv_id AND m.d <= b.d JOIN u a ON a.path = m.path GROUP BY 1)
    SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, CASE WHEN u.d > 0 THEN o.conv_id END AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
    FROM u LEFT JOIN u o ON o.path = u.up LEFT JOIN kids ON kids.up = u.path JOIN s ON s.path = u.path"""
