"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct shingles, each a 64-bit hash. Documents link when the
intersection of their sets reaches ``PERCENT`` of the union, so linked sets of n shingles
overlap in at least ``required(n)`` of them. The ``sketch_size(n)`` smallest hashes of
either set then have at least ``shared_at_least(n)`` in common. Three steps use that bound.

1. *Alone or not.* Sketch tokens are counted over all distinct texts. A document with fewer
   tokens met elsewhere than the bound asks for can link with nothing; its set is not built again.
2. *Groups.* The others are dealt by signatures, their smallest sketch token under a permutation.
   Each is compared with the most usual one of each of its signatures: links found there put a large
   family of copies into one component without its pairs. Documents of one component, signature
   and size make a group, or several of bounded size.
3. *Token-group matrix.* For every token the groups whose union holds it. A document probes
   with its rarest tokens, as many as the first common token of a link can be among, and reaches groups of other
   components that hold one of them in a place and size that allow a link. It counts its overlap with the union of
   every group reached, and opens the group only where that count reaches the bound.
   An open group returns what connects components, not pairs.

A task opens one group of bounded size for a bounded number of queries. Members of a family that
nearly link with its centre have as many tokens of their own as they probe with, so they reach
only members that share one of these. Families without a centre remain the costly case.

Defined results: a null or wordless text has no set and links with nothing; with fewer words
than the width the whole sequence is the one shingle; null ids are never the smallest of a
component unless all of it have none; rows with equal ids stay rows; an empty table gives no rows. Two
shingles count as one if their 64-bit hashes agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondpass.llm.common import id_and_text
from secondpass.llm.graph import components
from secondpass.session import pin

WIDTH, PERCENT = 4, 85
SLACK = 10  # percent of a set by which its sketch is longer than needed: that many tokens must be shared
SIGNATURES = 3  # permutations by which documents are dealt to their first comparison
MEMBERS, QUERIES = 128, 512  # of a group opened together
_WORDS = 1 << 19  # word hashes a worker remembers


def required(n: int) -> int:
    """Shingles that a set of ``n`` has in common with any set it links with, at least."""
    return -(-PERCENT * n // 100)


def shared_at_least(n: int) -> int:
    """Tokens that the sketch of ``n`` shingles has in common with that of any set it links with, at least."""
    return 1 + SLACK * required(n) // 100


def sketch_size(n: int) -> int:
    return n - required(n) + 1 + SLACK * n // 100 if n else 0


def _mix(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > _WORDS:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, 1)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.width, len(ids))
        hashes = np.full(len(ids) - size + 1, size, np.uint64)
        for i in range(size):
            hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + len(hashes)])
        return np.unique(hashes)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketched(width: int):
    def run(batches):
        shingles = Shingler(width)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [shingles(text.as_py()) for text in part.column(2)]
                sketches = [s[:sketch_size(len(s))] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), _lists(sketches)],
                    ["doc_id", "sha", "n", "sketch"])

    return run


def _full(width: int):
    def run(batches):
        shingles = Shingler(width)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _lists([shingles(t.as_py()) for t in part.column(2)])],
                    ["doc_id", "sha", "tokens"])

    return run


def linked(a: int, b: int, common):
    """Whether sets of ``a`` and ``b`` shingles link, given how many they have in common."""
    return 100 * common >= PERCENT * (a + b - common)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(v.values).view(np.uint64) for v in column]


def _open(members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links (u, v) that connect the components met in one group, given its members and some of its queries."""
    out = ([], [])
    if members.num_rows and queries.num_rows:
        nodes, sets = members["m_node"].to_numpy(), _arrays(members["m_tokens"])
        component = members["m_component"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        for node, own, asked in zip(queries["q_node"].to_pylist(), queries["q_component"].to_pylist(), _arrays(queries["q_tokens"])):
            if (component == own).all():
                continue
            low, high = np.searchsorted(tokens, asked, "left"), np.searchsorted(tokens, asked, "right")
            many = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            for i in np.flatnonzero(linked(len(asked), sizes, common) & (component != own)).tolist():
                one, other = root(own), root(int(component[i]))
                if one != other:
                    above[one] = other
                    out[0].append(node)
                    out[1].append(int(nodes[i]))
    return pa.table({"u": pa.array(out[0], pa.int64()), "v": pa.array(out[1], pa.int64())})


def opened(asked: DataFrame, members: DataFrame, sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (u, v) of queries (g, node) with members (g, node) of bounded groups that connect different components.

    ``sets`` holds the tokens of a node, ``placed`` its component. The queries of a group are dealt to tasks.
    """
    chunks = F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks")
    sizes = pin(asked.groupBy("g").agg(chunks), "group-sizes")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))

    def dealt(side: str, rows: DataFrame, chunk: Column) -> DataFrame:
        whole = rows.join(sizes, "g").select("g", "node", chunk.alias("chunk")).join(placed, "node").join(sets, "node")
        return whole.select(*[F.col(c).alias(f"{side}_{c}") for c in ("g", "chunk", "node", "component", "tokens")])

    left = dealt("m", members, every)
    right = dealt("q", asked, F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    return left.groupBy("m_g", "m_chunk").cogroup(right.groupBy("q_g", "q_chunk")).applyInArrow(_open, "u long, v long")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component, the smallest node of its component."""
    root = components(links).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pin(nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "placed")


def prefixes(full: DataFrame) -> DataFrame:
    """(node, token, n, top, mass): the rarest tokens of every set of ``n``, as many as a link can have its first common token among.

    Tokens are in one order for all sets, rare ones first. Sets whose first common token has ``p`` tokens before it in one of
    them have at most ``n - p`` in common, so the other has at most ``top``. ``mass`` is how often tokens of the set occur, on average.
    """
    df = full.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy("node")  # bounded by the document
    placed = full.join(df, "token").withColumn("_p", F.row_number().over(own.orderBy("df", "token")) - 1)
    placed = placed.withColumn("mass", F.avg("df").over(own)).withColumn(
        "top", F.floor(((100 + PERCENT) * (F.col("n") - F.col("_p")) - PERCENT * F.col("n")) / PERCENT))
    return placed.where((F.col("df") > 1) | (F.col("_p") == 0)).where(100 * F.col("top") >= PERCENT * F.col("n")).select(
        "node", "token", "n", "top", "mass", (F.col("df") > 1).alias("met"))


def matrix_of(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """The token-group matrix: every token with every group whose union holds it."""
    return pin(tokens.join(groups.select("node", "g"), "node").select("token", "g").distinct(), "token-group-matrix")


def reaching(probes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, g): groups of other components that hold a probe of a document in place and size as the first common token of a link is.

    Of two components the smaller one asks.
    """
    side = F.struct(F.col("members"), F.col("component"))
    asking = probes.join(groups.withColumn("side", side).select("node", "side"), "node")
    held = probes.select("node", "token", "n", "top").join(groups.withColumn("side", side).select("node", "g", "side"), "node")
    held = held.groupBy("token", "g").agg(
        F.first("side").alias("g_side"), F.first("n").alias("g_n"), F.max("top").alias("g_top"))
    meet = (F.col("side") < F.col("g_side")) & (F.col("n") <= F.col("g_top")) & (F.col("g_n") <= F.col("top"))
    held = held.withColumnRenamed("token", "g_token")
    return pin(asking.join(held, (F.col("token") == F.col("g_token")) & meet).select("node", "g").distinct(), "reached")


def qualifying(tokens: DataFrame, need: DataFrame, matrix: DataFrame, reached: DataFrame) -> DataFrame:
    """(g, node): of the groups reached those whose union holds as many sketch tokens of a document as a link needs."""
    overlap = tokens.join(reached, "node").join(matrix, ["token", "g"])
    bound = overlap.groupBy("node", "g").agg(F.count(F.lit(1)).alias("overlap"))
    return bound.join(need, "node").where("overlap >= need").select("g", "node")


def _links(tokens: DataFrame, sets: DataFrame, need: DataFrame) -> DataFrame:
    """Components (node, component) of documents, given their sketch tokens, sets and needs."""
    least = tokens.groupBy("node").agg(*[F.min(F.xxhash64("token", F.lit(i))).alias(f"s{i}") for i in range(SIGNATURES)])
    least = pin(least, "signatures")
    full = sets.join(least.select("node"), "node").select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    prefix = pin(prefixes(full), "prefixes")
    sizes = prefix.groupBy("node").agg(F.first("n").alias("n"), F.first("mass").alias("mass"))
    least = pin(least.join(sizes, "node"), "signatures")
    dealt = least.select("node", "mass", F.explode(F.array(*[F.xxhash64(F.lit(i), f"s{i}") for i in range(SIGNATURES)])).alias("g"))
    # Of copies with few edits the one whose tokens are met most is nearest to the others.
    first = dealt.groupBy("g").agg(F.max(F.struct("mass", "node")).alias("_m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = pin(first.select("g", "_m.node"), "first-of-signature")
    others = dealt.join(first.select("g", F.col("node").alias("first")), "g").where("node <> first").select("g", "node")
    alone = need.select("node", F.col("node").alias("component"))
    links = pin(opened(others, first, sets, alone), "star-links")

    # Groups of bounded size hold sets of one component, signature and size, so a document asks none of its own component.
    placed = _components(need, links)
    members = placed.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    kinds = ["component", "s0", "n"]
    dealt = least.join(placed, "node").join(members, "component").select("node", "members", *kinds)
    chunks = dealt.groupBy(*kinds).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("chunks"))
    groups = dealt.join(chunks, kinds).withColumn("g", F.xxhash64(*kinds, F.pmod(F.xxhash64("node"), F.col("chunks"))))
    groups = pin(groups.select("node", "component", "members", "g"), "groups")
    reached = reaching(prefix.where("met"), groups)
    asked = pin(qualifying(tokens, need, matrix_of(tokens, groups), reached), "qualifying")
    links = links.unionByName(pin(opened(asked, groups.select("g", "node"), sets, placed), "links"))
    return _components(need, links)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable over links, of every row."""
    source = id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    rows = source.mapInArrow(_sketched(width), "doc_id long, sha binary, n long, sketch array<long>")
    rows = pin(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")
    texts = rows.where("n > 0").groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    texts = pin(texts, "distinct-texts")
    total = texts.agg(F.sum("copies")).first()[0] or 0
    # Texts with a thousandth of all rows: at most a thousand, so they may be broadcast. One copy of them counts; the
    # copies of others count too, which can only let a text through that the exact count below stops.
    hot = F.col("copies") * 1000 >= max(total, 2000)
    frequent = F.broadcast(texts.where(hot).select(F.col("sha").alias("of"), "least"))
    once = rows.where("n > 0").join(frequent, F.col("sha") == F.col("of"), "left")
    once = once.where(F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))
    tokens = once.select("row", F.explode("sketch").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token")
    met = tokens.join(shared, "token").groupBy("row").agg(F.count(F.lit(1)).alias("met"))
    need = (F.lit(1) + F.floor(F.lit(SLACK) * F.ceil(F.lit(PERCENT) * F.col("n") / 100) / 100)).cast("long")
    met = met.join(rows.select("row", "sha", "n"), "row").withColumn("need", need).where("met >= need")
    active = pin(met.select("sha", "need").distinct().join(texts, "sha").select("sha", "need", "least"), "active-texts")

    chosen = active.select(F.col("sha").alias("of"), "least")
    built = source.join(chosen, (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    built = built.dropDuplicates(["sha"]).mapInArrow(_full(width), "doc_id long, sha binary, tokens array<long>")
    built = pin(built.select(F.monotonically_increasing_id().alias("node"), "sha", "tokens"), "sets")
    nodes = pin(built.select("node", "sha").join(active, "sha"), "nodes")
    size = F.size("tokens")
    sketch = F.slice("tokens", 1, (size - F.ceil(size * PERCENT / 100) + 1 + F.floor(size * SLACK / 100)).cast("int"))
    tokens = built.select("node", F.explode(sketch).alias("token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("token")
    tokens = pin(tokens.join(several, "token").select("node", "token"), "active-tokens")
    placed = _links(tokens, built.select("node", "tokens"), nodes.select("node", "need"))

    named = placed.join(nodes.select("node", "sha", "least"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_text = named.join(smallest, "component").select(F.col("sha").alias("of"), "component_id")
    of_text = texts.join(of_text, F.col("sha") == F.col("of"), "left").select(
        "sha", "copies", F.coalesce("component_id", "least").alias("component_id"))
    return _named(rows, pin(of_text, "components"), hot)


def _named(rows: DataFrame, of_text: DataFrame, hot: Column) -> DataFrame:
    """All rows with their component; the few texts that are ``hot`` are broadcast."""
    frequent = F.broadcast(of_text.where(hot).drop("copies"))
    narrow = rows.where("n > 0").select("doc_id", "sha", F.col("n").alias("n_shingles"))
    rest = narrow.join(frequent.select("sha"), "sha", "left_anti").join(of_text.where(~hot).drop("copies"), "sha")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    columns = ("doc_id", "n_shingles", "component_id")
    return rest.select(*columns).unionByName(narrow.join(frequent, "sha").select(*columns)).unionByName(empty)


def brute_force(texts: dict[int, str | None], width: int = WIDTH) -> dict[int, tuple[int, int]]:
    """(n_shingles, component_id) by comparing all pairs of word sequences; for tests."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    least = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and linked(len(sets[a]), len(sets[b]), len(sets[a] & sets[b])):
                    least[a] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in texts}
