"""Near duplicates by an inverted join on MinHash signature coordinates.

Documents with the same shingle set form one class.  Every class is posted under
its (coordinate, value) pairs.  Classes that agree on at least `t` of K
coordinates share one of the K - t + 1 rarest pairs of each, so only those are
posted, and pairs that nobody shares stand first and cost nothing.  Inside a
posting list pairs are not enumerated: a few rounds compare all members with
one pivot and skip what is connected already.  What then is still apart differs
from a pivot: members of one pivot are posted once more, under the shingles that
they lack of it or add to it (their delta).  Two of them can only be linked if
they share about half of the smaller delta, so the rarest part of each suffices,
and the similarity follows exactly from the deltas; pairs that share less are
never made.  Members of different pivots meet in the lists of coordinates.
Candidates from there must agree on `t` coordinates and are confirmed on their
full shingle sets.

`t` is the largest count that a pair at the wanted similarity misses with a
probability below `MISS`.  There is no cap on list lengths or partners.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.llm.components import components
from lethe.session import materialise

COORDINATES = 48
MISS = 1e-8
PIVOT_ROUNDS = 2
KEPT_WORDS = 300_000
CHUNK = 8_192
_MIX = np.uint64(0x9E3779B97F4A7C15)


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The largest t with P(Binomial(coordinates, percent / 100) < t) <= miss."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


class WordHashes(dict):
    """64-bit hash of each word met so far; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `words`-word shingles of a text, A-Z
    lower-cased; of the whole sequence when it is shorter; empty without words."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size * 0x51ED27, dtype=np.uint64)
    for k in range(size):
        total = (total ^ (total >> np.uint64(29))) * _MIX + h[k : len(h) - size + 1 + k]
    total ^= total >> np.uint64(32)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return np.unique(total)


def _permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(
        0, 2**63, coordinates, dtype=np.uint64
    )


def signature(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least 32-bit value of every coordinate over the set."""
    low = np.full(len(factors), 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        values = (hashes[at : at + CHUNK, None] * factors + shifts) >> np.uint64(32)
        np.minimum(low, values.min(axis=0), out=low)
    return low.astype(np.uint32)


def _signer(words: int, coordinates: int, seed: int):
    def sign(batches):
        known, (factors, shifts) = WordHashes(), _permutations(coordinates, seed)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingle_hashes(text, words, known)
                if len(hashes):
                    rows.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), signature(hashes, factors, shifts).tobytes()))
                else:
                    rows.append((0, None, None))
            n, same, sig = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"id": batch["id"], "body": batch["body"], "n": n, "same": same, "sig": sig})

    return sign


def _poster(batches):
    for batch in batches:
        values = np.concatenate([np.frombuffer(s, dtype=np.uint32) for s in batch["sig"]] or [np.empty(0, np.uint32)])
        k = len(values) // max(1, len(batch))
        tokens = (np.tile(np.arange(k, dtype=np.int64), len(batch)) << 32) | values.astype(np.int64)
        yield pd.DataFrame({"c": np.repeat(batch["c"].to_numpy(), k), "token": tokens})


def _matcher(least: int):
    def match(batches):
        for batch in batches:
            agree = [
                int((np.frombuffer(a, dtype=np.uint32) == np.frombuffer(b, dtype=np.uint32)).sum())
                for a, b in zip(batch["sig_a"], batch["sig_b"])
            ]
            yield batch.loc[np.array(agree, dtype=int) >= least, ["a", "b"]]

    return match


MAP_WORDS = 4  # longs of a map of missing shingles


def missing_map(missing: np.ndarray) -> list[int]:
    """One bit per shingle, at a place given by its hash; equal shingles share a place."""
    bits = [0] * MAP_WORDS
    for h in missing.tolist():
        place = (h >> 40) % (64 * MAP_WORDS)
        bits[place // 64] |= 1 << (place % 64)
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def _confirmer(words: int, percent: int):
    """Compare full sets; also say how many shingles `a` shares with `b` and which of `b` it lacks."""

    def confirm(batches):
        known, last, held = WordHashes(), None, None
        for batch in batches:
            linked, shared, maps = [], [], []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != last:
                    last, held = b, shingle_hashes(text_b, words, known)
                own = shingle_hashes(text_a, words, known)
                both = np.intersect1d(own, held, assume_unique=True)
                linked.append(100 * len(both) >= percent * (len(own) + len(held) - len(both)))
                shared.append(len(both))
                maps.append(missing_map(np.setdiff1d(held, both, assume_unique=True)))
            yield batch[["a", "b"]].assign(linked=linked, shared=shared, lacks=maps)

    return confirm


ADDED = np.int64(0x2545F4914F6CDD1D)  # tells an added shingle from a missing one


def _differ(words: int):
    """What `a` lacks of pivot `b` and what it adds, as one list, with the size of each part."""

    def compare(batches):
        known, last, held = WordHashes(), None, None
        for batch in batches:
            deltas, missing, sizes = [], [], []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != last:
                    last, held = b, shingle_hashes(text_b, words, known)
                own = shingle_hashes(text_a, words, known)
                lacks = np.setdiff1d(held, own, assume_unique=True).astype(np.int64)
                adds = np.setdiff1d(own, held, assume_unique=True).astype(np.int64) ^ ADDED
                deltas.append(np.concatenate([lacks, adds]))
                missing.append(len(lacks))
                sizes.append(len(held))
            yield pd.DataFrame({"c": batch["a"], "pivot": batch["b"], "pivot_n": sizes, "missing": missing, "delta": deltas})

    return compare


def _lister(words: int):
    def every(batches):
        known = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, words, known).astype(np.int64) for t in batch["text"]]
            yield pd.DataFrame(
                {"c": np.repeat(batch["c"].to_numpy(), [len(x) for x in sets]), "h": np.concatenate(sets) if sets else np.empty(0, np.int64)}
            )

    return every


def _possible(percent: int) -> Column:
    """A pair (n, s) and (pn, ps) may reach the similarity: only the `s` shingles that
    another candidate has as well can be shared."""
    most = F.least("s", "ps")
    return 100 * most >= percent * (F.col("n") + F.col("pn") - most)


def _not_apart(percent: int) -> Column:
    """Of two classes compared with the same pivot: what both can share, at most.

    They share what neither lacks of the pivot, and of the rest what is not their
    own alone.  Bits set in either map are at most as many as shingles lacking in either.
    """
    lacking = sum((F.bit_count(F.col("lacks")[i].bitwiseOR(F.col("placks")[i])) for i in range(1, MAP_WORDS)), F.bit_count(F.col("lacks")[0].bitwiseOR(F.col("placks")[0])))
    shared = F.col("pivot_n") - lacking + F.least("rest", "prest")
    reached = (100 + percent) * shared >= percent * (F.col("n") + F.col("pn"))
    return F.coalesce((F.col("pivot") != F.col("ppivot")) | reached, F.lit(True))


SIDE = ("c", "n", "s", "comp", "pivot", "pivot_n", "rest", "lacks", "tokens")


def _other(frame: DataFrame, *keep: str) -> DataFrame:
    return frame.select(*keep, *[F.col(x).alias(f"p{x}") for x in SIDE if x != "pivot_n"])


def _pivot_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a: member, b: pivot) of every posting list, unless both are connected already.

    The pivot is the member with the smallest share of shingles of its own, which
    is the nearest to a common origin; a later turn takes another one of these.
    """
    order = F.struct(  # the lists' own order of pivots; `tokens` stays out of it by standing last
        F.when(F.col("pivot") == F.col("c"), F.lit(1)).otherwise(F.lit(0)).alias("o"), (F.lit(1) - F.col("s") / F.col("n")).alias("u"), *SIDE
    )
    pivots = members.groupBy("token").agg(F.min(order).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_lists = pivots.where("low < high").select("token", *[F.col(f"p.{x}").alias(f"p{x}") for x in SIDE if x != "pivot_n"])
    met = members.join(open_lists, "token").where(F.col("comp") != F.col("pcomp"))
    return met.where(_possible(percent) & _not_apart(percent)).select(F.col("c").alias("a"), F.col("pc").alias("b")).distinct()


def _delta_links(deltas: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (a, b) of different components among the members of each pivot.

    `deltas` has (c, comp, pivot, pivot_n, missing, delta).  With m shingles
    missing and k added, w = 100 m + percent k, and W = (100 - percent) * pivot_n,
    two members are linked where (100 + percent) * shared >= w + pw - W, `shared`
    being what their deltas have in common.  Members with w <= W are linked with
    the pivot, so one of a wanted pair (`out`) has w > W, and both share more than
    w / (100 + percent) of the other's delta.
    """
    weight = F.lit(100) * F.col("missing") + percent * (F.size("delta") - F.col("missing"))
    sized = deltas.select("c", "comp", "pivot", "delta", F.size("delta").alias("d"), weight.alias("w"), ((100 - percent) * F.col("pivot_n")).alias("most"))
    held = materialise(sized.withColumn("out", F.col("w") > F.col("most")), "deltas")
    each = held.select("pivot", "c", F.explode("delta").alias("e"))
    shared = each.groupBy("pivot", "e").agg(F.count("*").alias("df")).where("df > 1")
    # per class at most its own delta; shingles that no other delta has come first in the order of rarity
    ranked = each.join(shared, ["pivot", "e"]).groupBy("pivot", "c").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("ranked"))
    whole = 100 + percent
    near = F.col("d") - F.floor(F.col("w") / whole)  # against members that are out
    far = F.when(F.col("out"), F.col("d") - F.ceil((F.col("w") - F.col("most")) / whole) + 1).otherwise(near)  # against linked ones
    alone = F.col("d") - F.size("ranked")
    posts = (
        held.drop("delta")
        .join(ranked, ["pivot", "c"])
        .select("*", (near - alone).cast("int").alias("near"), (far - alone).cast("int").alias("far"))
        .where("far > 0 OR near > 0")
        .select("pivot", "c", "comp", "out", "near", F.posexplode(F.slice("ranked", F.lit(1), F.greatest("near", "far", F.lit(0)))).alias("at", "x"))
        .select("pivot", "c", "comp", "out", F.col("x.e").alias("e"), (F.col("at") < F.col("near")).alias("close"))
    )
    posts = materialise(posts, "delta-postings")
    left = posts.where("out")
    right = posts.where("close").select("pivot", "e", F.col("c").alias("pc"), F.col("comp").alias("pcomp"), F.col("out").alias("pout"))
    once = ~F.col("pout") | (F.col("close") & (F.col("c") < F.col("pc")))
    met = left.join(right, ["pivot", "e"]).where((F.col("comp") != F.col("pcomp")) & once).select("pivot", "c", "pc").distinct()
    sides = held.select("pivot", "c", "w", "most", "delta"), held.select("pivot", F.col("c").alias("pc"), F.col("w").alias("pw"), F.col("delta").alias("pdelta"))
    pairs = met.join(sides[0], ["pivot", "c"]).join(sides[1], ["pivot", "pc"])
    reached = whole * F.size(F.array_intersect("delta", "pdelta")).cast("bigint") >= F.col("w") + F.col("pw") - F.col("most")
    return pairs.where(reached).select(F.greatest("c", "pc").alias("a"), F.least("c", "pc").alias("b"))


def _rest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a list in different components and of different pivots:
    one of each pair is outside the list's largest component, so that one is
    paired with all."""
    sizes = members.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("parts"))
    lists = main.where("parts > 1").select("token", F.col("m.comp").alias("main"))
    open_members = members.join(lists, "token")
    outside = _other(open_members.where("comp <> main"), "token")
    # a pair of two outsiders is met from both sides; one is enough
    once = (F.col("comp") != F.col("pcomp")) & ((F.col("comp") == F.col("main")) | (F.col("c") < F.col("pc")))
    # of all lists that hold both, the first one gives the pair
    first = F.col("token") == F.array_min(F.array_intersect("tokens", "ptokens"))
    # members of one pivot have met by their deltas, and each its pivot
    known = (F.col("pivot") == F.col("ppivot")) | (F.col("pivot") == F.col("pc")) | (F.col("ppivot") == F.col("c"))
    met = open_members.join(outside, "token").where(once & ~F.coalesce(known, F.lit(False)) & _possible(percent) & first)
    return met.select(F.greatest("c", "pc").alias("a"), F.least("c", "pc").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(`id_col`, body, n_shingles, component_id, component): one row per row of `docs`.

    Two documents are linked when the Jaccard similarity of their sets of
    `words`-word shingles is at least `percent` / 100; `component_id` is the
    smallest id reachable, `component` a number of its own, null without words.
    `body` is the text's 64-bit hash, which with the id finds the row again.  Null and empty texts, and texts without words, are
    linked with nothing and have their own id.  Null ids take part and are never
    a component's id unless all are null.  Repeated rows are linked; other
    columns are not read; an empty table gives no rows.
    """
    least = match_threshold(coordinates, percent)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    signed = materialise(
        narrow.mapInPandas(_signer(words, coordinates, seed), "id bigint, body bigint, n bigint, same binary, sig binary"), "signatures"
    )
    # one class per distinct set; copies collapse on the map side
    classes = materialise(
        signed.where("n > 0")
        .groupBy("same")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("z"), "id", "body")).alias("first"),
            F.first("sig").alias("sig"),
            F.first("n").alias("n"),
        )
        .select(F.monotonically_increasing_id().alias("c"), "same", "first.id", "first.body", "sig", "n"),
        "classes",
    )
    tokens = classes.select("c", "sig").mapInPandas(_poster, "c bigint, token bigint")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # per class at most `coordinates` entries; values of its own come first in the order of rarity
    counted = tokens.join(shared, "token").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    room = F.lit(coordinates - least + 1) - (F.lit(coordinates) - F.size("held"))
    kept = F.transform(F.slice("held", F.lit(1), room), lambda h: h["token"])
    postings = materialise(counted.where(room > 0).select("c", kept.alias("tokens")), "postings")
    wanted = classes.join(postings.select("c"), "c").select("c", F.col("id").alias("_id"), F.col("body").alias("_body"))
    found = narrow.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")))
    texts = materialise(found.select("c", "text").dropDuplicates(["c"]), "candidate-texts")
    # how many shingles of a class another candidate has as well
    own = texts.mapInPandas(_lister(words), "c bigint, h bigint").groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c"))
    alone = own.where("m = 1").groupBy("c").agg(F.count("*").alias("alone"))
    sizes = classes.select("c", "n").join(texts.select("c"), "c").join(alone, "c", "left")
    shares = sizes.select("c", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")).where(100 * F.col("s") >= percent * F.col("n"))
    postings = materialise(postings.join(shares, "c").select("*", F.explode("tokens").alias("token")), "narrowed-postings")
    signatures = classes.select("c", "sig")
    compared = "a bigint, b bigint, linked boolean, shared bigint, lacks array<bigint>"

    def compare(pairs: DataFrame) -> DataFrame | None:
        """Pairs that agree on enough coordinates, compared on their full sets."""
        signs = signatures.select(F.col("c").alias("a"), F.col("sig").alias("sig_a")), signatures.select(F.col("c").alias("b"), F.col("sig").alias("sig_b"))
        matched = materialise(pairs.join(signs[0], "a").join(signs[1], "b").mapInPandas(_matcher(least), "a bigint, b bigint"), "matched")
        if matched.isEmpty():
            return None
        return materialise(matched.join(bodies[0], "a").join(bodies[1], "b").mapInPandas(_confirmer(words, percent), compared), "compared")

    bodies = texts.select(F.col("c").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("c").alias("b"), F.col("text").alias("text_b"))

    # roots holds (node, root) of all classes that have a link so far, near the pivot that each class keeps:
    # of all it was compared with, the one that most others were compared with as well
    roots, near = None, None

    def with_component(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("comp", F.col("c"))
        return rows.join(roots, F.col("c") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "c").alias("comp"))

    def connect(new: DataFrame) -> DataFrame:
        known = new if roots is None else new.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        return materialise(components(known), "roots")

    def with_pivot() -> DataFrame:
        members = with_component(postings)
        if near is None:
            empty = {"pivot": "bigint", "pivot_n": "bigint", "rest": "bigint", "lacks": "array<bigint>"}
            members = members.select("*", *[F.lit(None).cast(t).alias(x) for x, t in empty.items()])
        else:
            members = members.join(near, "c", "left").withColumn("rest", F.col("s") - F.col("shared"))
        return members.select("token", *SIDE)

    for turn in range(PIVOT_ROUNDS):
        found = compare(_pivot_pairs(with_pivot(), turn, percent))
        if found is None:
            continue
        seen = found.join(classes.select(F.col("c").alias("b"), F.col("n").alias("pivot_n")), "b").select(
            F.col("a").alias("c"), F.col("b").alias("pivot"), "pivot_n", "shared", "lacks"
        )
        # a pivot lacks nothing of itself
        itself = seen.select("pivot", "pivot_n").distinct().select(
            F.col("pivot").alias("c"), "pivot", "pivot_n", F.col("pivot_n").alias("shared"), F.array_repeat(F.lit(0).cast("bigint"), MAP_WORDS).alias("lacks")
        )
        met = seen.unionByName(itself)
        every = met.join(met.groupBy("pivot").agg(F.count("*").alias("popular")), "pivot")
        every = every if near is None else every.unionByName(near)
        best = F.max(F.struct("popular", "shared", "pivot", "pivot_n", "lacks")).alias("x")
        near = materialise(every.groupBy("c").agg(best).select("c", "x.pivot", "x.pivot_n", "x.shared", "x.lacks", "x.popular"), "near-pivots")
        roots = connect(found.where("linked").select("a", "b"))
    if near is not None:
        placed = materialise(with_component(near.select("c", "pivot")), "pivot-members")
        apart = placed.groupBy("pivot").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("pivot")
        again = placed.join(apart, "pivot").where("c <> pivot")
        fields = "c bigint, pivot bigint, pivot_n bigint, missing bigint, delta array<bigint>"
        pairs = again.select(F.col("c").alias("a"), F.col("pivot").alias("b")).join(bodies[0], "a").join(bodies[1], "b")
        deltas = pairs.mapInPandas(_differ(words), fields).join(again.select("c", "comp"), "c")
        roots = connect(_delta_links(deltas, percent))
    found = compare(_rest_pairs(with_pivot(), percent))
    if found is not None:
        roots = connect(found.where("linked").select("a", "b"))
    if roots is None:
        rooted = classes.select("same", "id", F.col("c").alias("root"))
    else:
        rooted = classes.join(roots, F.col("c") == F.col("node"), "left").select("same", "id", F.coalesce("root", "c").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("same").alias("_same"), "component_id", "root")
    return signed.join(named, F.col("same") == F.col("_same"), "left").select(
        F.col("id").alias(id_col),
        "body",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("root").alias("component"),
    )


def _row_key(id_column: Column) -> Column:
    return F.xxhash64(id_column.isNull(), id_column)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each component: that of its
    smallest id (null last), one of them where rows are repeated.  Texts without
    words all stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where(F.col("component").isNotNull())
    key = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("id"), F.col("body").alias("body"))
    keepers = found.groupBy("component").agg(F.min(key).alias("k")).select(_row_key(F.col("k.id")).alias("_kept_id"), F.col("k.body").alias("_kept_body"))
    keyed = docs.withColumn("_kept_id", _row_key(F.col(id_col).cast("bigint"))).withColumn("_kept_body", F.xxhash64(text))
    spoken = text.rlike(r"[^\x20\x09-\x0D]")
    one = F.row_number().over(Window.partitionBy("_kept_id", "_kept_body").orderBy("_kept_id"))
    kept = keyed.where(spoken).join(keepers, ["_kept_id", "_kept_body"], "left_semi").withColumn("_kept_no", one).where("_kept_no = 1")
    return kept.select(*docs.columns).unionByName(docs.where(~spoken))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + 2], ' ') END AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach) AS component_id, d.doc_id = min(r.reach) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n"""


@query("op5_coordinate_join", SQL)
def coordinate_join(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
