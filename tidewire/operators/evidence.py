"""Claims and evidence: where articles come from, and how many independent sources a claim has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text
from tidewire.operators.serving import page_of
from tidewire.operators.slices import numbered, sliced
from tidewire.sources import io


def independent_source_count(evidence: DataFrame) -> DataFrame:
    """Distinct provenance roots per claim (A1)."""
    return evidence.groupBy("claim_id").agg(F.count_distinct(F.coalesce("root_id", "id")).alias("independent"), F.count(F.lit(1)).alias("evidence"))


def claim_provenance(evidence: DataFrame) -> DataFrame:
    """Counts and the latest official confirmation and denial per claim (A2), one aggregate."""
    official = F.col("source_type") == "CLUB_OFFICIAL"
    order = F.struct("published_at", "id")
    return evidence.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("evidence"),
        F.count_distinct(F.coalesce("root_id", "id")).alias("independent"),
        F.max_by("id", F.when(official & (F.col("direction") == "CONFIRMS"), order)).alias("confirmation_id"),
        F.max_by("id", F.when(official & (F.col("direction") == "DENIES"), order)).alias("denial_id"),
    )


def provenance_clusters(evidence: DataFrame) -> DataFrame:
    """Per claim and root the number of copies and when the root's cluster began (A2)."""
    root = F.coalesce("root_id", "id")
    return evidence.groupBy("claim_id", root.alias("root_id")).agg(F.count_if(F.col("id") != root).alias("copies"), F.min("published_at").alias("since"))


def cluster_members(evidence: DataFrame) -> DataFrame:
    """(claim_id, root_id, id, syndicated, nth): a claim's clusters with their lists as rows, the root first and then its copies in time (A2).

    The root is the item with the cluster's id, or where that is not among the claim's items, the earliest one. Rows and not arrays: a
    cluster may hold a third of all items; only the root is looked for by cluster, copies are numbered within slices of time.
    """
    root = F.coalesce("root_id", "id")
    rows = sliced(evidence.select("claim_id", root.alias("root_id"), "id", "published_at"), F.unix_micros(F.col("published_at").cast("timestamp")))
    rows = io.materialise(rows, "clusters")
    at = F.struct((F.col("id") != F.col("root_id")).alias("other"), "published_at", "id")
    heads = rows.groupBy(F.col("claim_id").alias("_c"), F.col("root_id").alias("_r")).agg(F.min_by("id", at).alias("_head"))
    rows = rows.join(heads, F.col("claim_id").eqNullSafe(F.col("_c")) & (F.col("root_id") == F.col("_r"))).withColumn("syndicated", F.col("id") != F.col("_head")).drop("_c", "_r", "_head")
    per = rows.where("syndicated").groupBy(F.col("claim_id").alias("_c"), F.col("root_id").alias("_r"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_c", "_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))  # a row a slice
    per = per.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("claim_id", "root_id", "_slice", "syndicated").orderBy("published_at", "id"))
    met = rows.withColumn("_nth", nth).join(per, F.col("claim_id").eqNullSafe(F.col("_c")) & (F.col("root_id") == F.col("_r")) & (F.col("_slice") == F.col("_s")), "left")
    return met.select("claim_id", "root_id", "id", "syndicated", F.when(F.col("syndicated"), F.col("_nth") + F.col("before")).otherwise(0).cast("long").alias("nth"))


def last_evidence_at(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per claim the later of its stored time and its newest evidence (A5)."""
    newest = evidence.groupBy(F.col("claim_id").alias("_c")).agg(F.max("published_at").alias("newest"))
    return claims.join(newest, F.col("id") == F.col("_c"), "left").select("id", F.greatest("last_evidence_at", "newest").alias("last_evidence_at"))


def match_cited_source(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, cited_source_id): the source that the text cites (T11, T12): equal keys first, then two or more words of
    which one set holds the other; lowest id wins; never the own source. Words are matched by an equi-join."""
    cited = evidence.select("id", "source_id", text.source_key(text.cited_name(F.col("text"))).alias("cited")).where("cited <> ''")
    known = sources.select(F.col("id").alias("sid"), text.source_key(F.col("name")).alias("key"))
    same = cited.join(known, F.col("cited") == F.col("key")).select("id", "source_id", "sid", F.lit(0).alias("rule"))
    # One set holds the other, so they meet on the rarest word of the smaller one, by how many sources have the word; no join on common words.
    words = lambda c: F.array_distinct(F.split(c, " "))
    a = cited.select("id", "source_id", words(F.col("cited")).alias("cw")).where("size(cw) > 1")
    b = known.select("sid", words(F.col("key")).alias("kw")).where("size(kw) > 1")
    spread = b.select("sid", "kw", F.explode("kw").alias("w"))
    often = spread.groupBy(F.col("w").alias("_w")).agg(F.count(F.lit(1)).alias("df"))
    rarest = spread.join(often, F.col("w") == F.col("_w")).groupBy("sid", "kw").agg(F.min(F.struct("df", "w"))["w"].alias("k"))
    asked = a.select("id", "source_id", "cw", F.explode("cw").alias("w")).join(often, F.col("w") == F.col("_w"), "left")
    own = asked.groupBy("id", "source_id", "cw").agg(F.min(F.when(F.col("df").isNotNull(), F.struct("df", "w")))["w"].alias("k"), F.count_if(F.col("df").isNull()).alias("strange")).where("strange = 0")
    holds = asked.join(rarest, F.col("w") == F.col("k")).where(F.size(F.array_except("kw", "cw")) == 0).select("id", "source_id", "sid")
    held = own.join(spread, F.col("k") == F.col("w")).where(F.size(F.array_except("cw", "kw")) == 0).select("id", "source_id", "sid")
    part = holds.unionByName(held).distinct().withColumn("rule", F.lit(1))
    # The own source is taken out before the choice, so that another match can win.
    hits = same.unionByName(part).where(~F.col("sid").eqNullSafe(F.col("source_id")))
    return hits.groupBy("id").agg(F.min_by("sid", F.struct("rule", "sid")).alias("cited_source_id"))


def attribution_parents(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, parent_id): the cited source's earliest published item on the claim among those ingested before."""
    one = evidence.select("id", "claim_id", "seq").join(cited, "id")
    other = evidence.select(F.col("id").alias("pid"), F.col("claim_id").alias("_claim"), F.col("source_id").alias("_src"), F.col("seq").alias("_seq"), F.col("published_at").alias("_at"))
    met = one.join(other, (F.col("claim_id") == F.col("_claim")) & (F.col("cited_source_id") == F.col("_src")) & (F.col("_seq") < F.col("seq")))
    return met.groupBy("id").agg(F.min_by("pid", F.struct("_at", "_seq")).alias("parent_id"))


def resolve_roots(parents: DataFrame) -> DataFrame:
    """(id, root_id) from (id, parent_id) by pointer doubling (A3). Parents come earlier; a cycle is an error. The
    rounds are the logarithm of the longest chain. Every round is a table in the shared folder."""
    at = io.materialise(parents.select("id", F.coalesce("parent_id", "id").alias("root_id")), "roots")
    most, rounds = None, 0
    while True:
        up = at.select(F.col("id").alias("_id"), F.col("root_id").alias("_up"))
        after = io.materialise(at.join(up, F.col("root_id") == F.col("_id"), "left").select("id", F.coalesce("_up", "root_id").alias("root_id"), (F.col("_up") != F.col("root_id")).alias("moved")), "roots")
        at = after.select("id", "root_id")
        if after.where("moved").isEmpty():
            break
        most, rounds = most or at.count().bit_length() + 1, rounds + 1
        if rounds > most:
            raise ValueError("parents form a cycle")
    # a cycle of two, four, eight .. items settles on these items themselves
    looped = parents.where("parent_id <> id").select(F.col("id").alias("_l")).join(at.where("root_id = id"), F.col("_l") == F.col("id"))
    if not looped.isEmpty():
        raise ValueError("parents form a cycle")
    return at


BITS, BLOCK, BLOCK_BITS, TILE = 4, 8192, 1 << 27, 1024  # bits a token at least; items and bits of a block at most; items compared at once


def _signatures(items: DataFrame) -> DataFrame:
    """(u, signature): a bit a token, by its hash, in a power of two of bits that is BITS times the tokens or more (64 at least). items: u, bits, t."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tokens, width = batch.column("h"), batch.column("bits").to_numpy() // 8
            hashes, per = tokens.flatten().to_numpy().view(np.uint64), np.diff(tokens.offsets.to_numpy())
            ends = np.cumsum(width)
            bit = hashes % np.repeat(width * 8, per).astype(np.uint64)
            out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
            np.bitwise_or.at(out, np.repeat(ends - width, per) + (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])], ["u", "signature"])

    return items.select("u", "bits", F.transform("t", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(run, "u long, signature binary")


def _near_in_blocks(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the items of two blocks whose sizes and signatures leave room for the threshold. met: key, side, u, n, signature; sorted by key and
    side within a partition. side 0 and 1 are the two blocks, 2 is a block that meets itself."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(rows):
            raw = b"".join(r.as_py() for r in rows[2])
            return rows[0], rows[1], np.frombuffer(raw, np.uint8).reshape(len(rows[0]), -1)

        def compared(one, two):
            width = min(one[2].shape[1], two[2].shape[1])  # the wider is folded
            one, two = ((u, n, np.bitwise_or.reduce(s.reshape(len(u), -1, width), axis=1)) for u, n, s in (one, two))
            own = one[0] is two[0]
            for k in range(0, len(one[0]), TILE):
                x, nx = np.unpackbits(one[2][k : k + TILE], axis=1).astype(np.float32), one[1][k : k + TILE, None]
                px = x.sum(axis=1)[:, None]
                for m in range(0, k + 1 if own else len(two[0]), TILE):
                    ny = two[1][m : m + TILE]
                    if np.minimum(nx.max(), ny.max()) < threshold * np.maximum(nx.min(), ny.min()) - 1e-6:
                        continue
                    y = np.unpackbits(two[2][m : m + TILE], axis=1).astype(np.float32)
                    both = x @ y.T
                    need = (nx + ny) * (threshold / (1 + threshold)) - 1e-6
                    good = (nx - px + both >= need) & (ny - y.sum(axis=1) + both >= need) & (np.minimum(nx, ny) >= np.maximum(nx, ny) * threshold - 1e-6)
                    i, j = np.nonzero(np.tril(good, -1) if own and k == m else good)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(one[0][k + i]), pa.array(two[0][m + j])], ["a", "b"])

        def done(parts):
            by = {}
            for side, *rows in parts:
                by.setdefault(side, []).append(rows)
            sides = {s: packed([np.concatenate([r[0] for r in x]), np.concatenate([r[1] for r in x]), [v for r in x for v in r[2]]]) for s, x in by.items()}
            if 2 in sides:
                yield from compared(sides[2], sides[2])
            elif len(sides) == 2:
                yield from compared(sides[0], sides[1])

        key, parts = None, []
        for batch in batches:
            keys, side = batch.column("key").to_numpy(), batch.column("side").to_numpy()
            u, n, signature = batch.column("u").to_numpy(), batch.column("n").to_numpy().astype(np.float64), batch.column("signature")
            at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (side[1:] != side[:-1])])) if len(keys) else []
            for first, end in zip(at, [*at[1:], len(keys)], strict=True):
                if key is not None and keys[first] != key:
                    yield from done(parts)
                    parts = []
                key = keys[first]
                parts.append((int(side[first]), u[first:end], n[first:end], signature.slice(first, end - first)))
        if parts:
            yield from done(parts)

    return met.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "a long, b long")


def near_duplicate_pairs(evidence: DataFrame, threshold: float = 0.55, fresh: str | None = None) -> DataFrame:
    """(item_id, candidate_id, similarity): pairs of a claim, later and earlier, with token Jaccard from the threshold.

    Items of a claim with equal token sets are a class; its first item stands for it. Every other item is one row with that
    first item, similarity 1; only first items are compared, so a group of copies gives as many rows as it has items. Items without
    tokens (a null text has none) are a class; items without a claim are one claim.

    First items of a claim are cut by size into blocks, and blocks whose sizes allow the threshold meet, one task a pair of them. An item is a
    signature of BITS bits a token there: the bits that only one side has show how many of its tokens the other lacks at least. What the
    sizes and these bounds leave meets whole token sets. Pairs within a claim are all looked at, so the time is quadratic in the largest
    claim; memory is two blocks a task, and of an item only its signature is sent, once for each block that it meets.

    fresh: a boolean column; then only pairs whose later item has it true are looked for.
    """
    mark = F.lit(True) if fresh is None else F.col(fresh)
    items = evidence.select("id", "claim_id", "seq", mark.alias("fresh"), F.coalesce(F.array_sort(text.tokens(F.col("text"))), F.array().cast("array<string>")).alias("t"))
    items = items.withColumn("n", F.size("t")).withColumn("digest", F.unhex(F.sha2(F.array_join("t", " "), 256))).withColumn("u", F.monotonically_increasing_id())
    items = io.materialise(items, "near-items")
    classes = items.groupBy(F.col("claim_id").alias("_claim"), F.col("digest").alias("_digest")).agg(F.min_by(F.struct("id", "u"), F.struct("seq", "id", "u")).alias("_first"), F.count(F.lit(1)).alias("_many"))
    classes = io.materialise(classes, "near-classes")
    copied = classes.where("_many > 1").withColumn("_first", F.col("_first.id"))
    copies = items.select("id", "claim_id", "digest", "fresh").join(copied, F.col("claim_id").eqNullSafe(F.col("_claim")) & (F.col("digest") == F.col("_digest"))).where("id <> _first and fresh").select(F.col("id").alias("item_id"), F.col("_first").alias("candidate_id"), F.lit(1.0).alias("similarity"))

    bits = F.greatest(F.lit(64), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") * BITS))).cast("int"))
    firsts = items.where("n > 0").select("claim_id", "n", "u").join(classes.select(F.col("_first.u").alias("_f")), F.col("u") == F.col("_f"), "left_semi").withColumn("bits", bits)
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), (F.lit(BLOCK_BITS) / F.col("bits")).cast("int")))
    dealt = numbered(firsts, ["claim_id", "bits"], [F.col("n"), F.col("u")], "nth").withColumn("block", F.struct("bits", F.floor((F.col("nth") - 1) / room).alias("k"))).select("claim_id", "n", "u", "block")
    dealt = io.materialise(dealt, "near-blocks")
    blocks = dealt.groupBy("claim_id", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("many"))
    a, b = blocks.alias("a"), blocks.alias("b")
    several = (F.col("a.block") > F.col("b.block")) | ((F.col("a.block") == F.col("b.block")) & (F.col("a.many") > 1))
    meet = a.join(b, F.col("a.claim_id").eqNullSafe(F.col("b.claim_id")) & several & (F.col("b.high") >= F.col("a.low") * threshold - 1e-6))
    key = F.xxhash64("a.claim_id", F.col("a.claim_id").isNull(), "a.block", "b.block")
    ends = F.when(F.col("a.block") == F.col("b.block"), F.array(F.struct(F.col("a.block").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("a.block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b.block").alias("block"), F.lit(1).alias("side"))))
    meet = meet.select(F.col("a.claim_id").alias("_claim"), key.alias("key"), F.explode(ends).alias("e")).select("_claim", "key", F.col("e.block").alias("_block"), "e.side")
    signed = dealt.join(_signatures(items.where("n > 0").withColumn("bits", bits)).withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
    met = signed.join(meet, F.col("claim_id").eqNullSafe(F.col("_claim")) & (F.col("block") == F.col("_block"))).select("key", "side", "u", "n", "signature")
    pairs = io.materialise(_near_in_blocks(met, threshold), "near-met")

    side = lambda x: items.select(*[F.col(c).alias(f"{x}_{c}") for c in ("u", "id", "claim_id", "seq", "fresh", "t")])
    full = pairs.join(side("l"), F.col("a") == F.col("l_u")).join(side("r"), F.col("b") == F.col("r_u")).where(F.col("l_claim_id").eqNullSafe(F.col("r_claim_id")))
    later = F.struct("l_seq", "l_id") > F.struct("r_seq", "r_id")
    score = F.size(F.array_intersect("l_t", "r_t")) / F.size(F.array_union("l_t", "r_t"))
    found = full.where(F.when(later, F.col("l_fresh")).otherwise(F.col("r_fresh"))).select(F.when(later, F.col("l_id")).otherwise(F.col("r_id")).alias("item_id"), F.when(later, F.col("r_id")).otherwise(F.col("l_id")).alias("candidate_id"), score.alias("similarity"))
    return found.where(F.col("similarity") >= threshold).unionByName(copies)


def resolve_duplicates(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merges: a candidate takes the item's root; other rows stay (A4). decisions: item_id, candidate_id, merge."""
    roots = evidence.select(F.col("id").alias("_i"), F.coalesce("root_id", "id").alias("_root"))
    to = decisions.where("merge").join(roots, F.col("item_id") == F.col("_i")).groupBy(F.col("candidate_id").alias("_c")).agg(F.min("_root").alias("_to"))
    return evidence.join(to, F.col("id") == F.col("_c"), "left").withColumn("root_id", F.coalesce("_to", "root_id")).drop("_c", "_to")


def review_duplicates(candidates: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The candidate pairs with reviewed_at stamped on those decided, merged or not (A4). candidates: item_id, candidate_id, reviewed_at; decisions as in resolve_duplicates."""
    done = decisions.select(F.col("item_id").alias("_i"), F.col("candidate_id").alias("_c")).distinct()
    met = candidates.join(done, (F.col("item_id") == F.col("_i")) & (F.col("candidate_id") == F.col("_c")), "left")
    return met.withColumn("reviewed_at", F.when(F.col("_i").isNotNull(), now).otherwise(F.col("reviewed_at"))).drop("_i", "_c")


def claims_with_source_tier(claims: DataFrame, evidence: DataFrame, sources: DataFrame, tier: int) -> DataFrame:
    """Claims with evidence from a source of that tier or better (J16), two semi joins."""
    good = sources.where(F.col("tier") <= tier).select(F.col("id").alias("_s"))
    seen = evidence.join(good, F.col("source_id") == F.col("_s"), "left_semi").select(F.col("claim_id").alias("_c"))
    return claims.join(seen, F.col("id") == F.col("_c"), "left_semi")


def list_claims(claims: DataFrame, evidence: DataFrame, sources: DataFrame, player_id: int | None = None, status: str | None = None, tier: int | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of claims, those with the newest evidence first, with the total of all that pass the filters."""
    rows = claims
    if player_id is not None:
        rows = rows.where(F.col("player_id") == player_id)
    if status is not None:
        rows = rows.where(F.col("claim_status") == status)
    if tier is not None:
        rows = claims_with_source_tier(rows, evidence, sources, tier)
    return page_of(rows, [F.desc("last_evidence_at"), F.col("id")], page, limit)


def categorise_evidence(evidence: DataFrame) -> DataFrame:
    """(id, categories): official, denial, contextual, and original, corroboration or syndication."""
    is_root = F.coalesce("root_id", "id") == F.col("id")
    official, direction = F.col("source_type") == "CLUB_OFFICIAL", F.col("direction")
    breaking = is_root & ~official & ~direction.isin("DENIES", "CONTEXTUAL")
    # the earliest breaking root of each claim, by an aggregate that combines before the shuffle
    firsts = evidence.where(breaking).groupBy(F.col("claim_id").alias("_c")).agg(F.min(F.struct("published_at", "id")).alias("_first"))
    first = F.struct("published_at", "id") == F.col("_first")
    role = F.when(~is_root, "syndication").when(F.col("breaking"), F.when(first, "original").otherwise("corroboration"))
    marks = F.array(F.when(official, "official"), F.when(direction == "DENIES", "denial"), F.when(direction == "CONTEXTUAL", "contextual"), role)
    return evidence.withColumn("breaking", breaking).join(firsts, F.col("claim_id").eqNullSafe(F.col("_c")), "left").select("id", "claim_id", F.array_join(F.array_compact(marks), ",").alias("categories"))


def find_or_create_claims(seen: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per (player, from, to) seen, nulls equal: the active claim's id, or null where one is to be created."""
    keys = ["player_id", "from_club_id", "to_club_id"]
    new = seen.groupBy(*keys).agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_evidence_at"))
    old = claims.where("claim_status = 'ACTIVE'").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("id").alias("claim_id"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return new.join(old, on[0] & on[1] & on[2], "left").drop(*[f"_{k}" for k in keys])


def ingest_evidence(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Items not stored yet: one per (url, claim), the first content wins (ST7's batch twin)."""
    first = new.groupBy("canonical_url", "claim_id").agg(F.min_by(F.struct(*new.columns), F.struct("fetched_at", "id")).alias("r")).select("r.*")
    old = existing.select(F.col("canonical_url").alias("_u"), F.col("claim_id").alias("_c"))
    return first.join(old, (F.col("canonical_url").eqNullSafe(F.col("_u"))) & (F.col("claim_id").eqNullSafe(F.col("_c"))), "left_anti")
