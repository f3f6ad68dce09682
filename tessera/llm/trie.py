"""Prefix trie of conversations, its subtrees summed by peeling leaves.

A node is a distinct sequence of first turns. Nodes hold a counter of children that have not finished. A node without
any is complete: it sends the totals of its subtree to its parent and leaves the table, until only the root finishes.
Peeling alone takes as many rounds as the trie is deep, so between two peelings each chain of nodes with one unfinished
child is folded onto the node at its end by pointer doubling; the chain's nodes get their totals from that node later.
So the number of rounds grows with the logarithm of the trie's size, whatever its depth. A node with one member needs no
message: below it is that member's own path, one leaf and nothing shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize

#: A conversation takes over turns of the first one among so many neighbours (fixed value), at most HEAD of them.
NEIGHBOURS, HEAD = 20, 3
#: Turns of one conversation that are numbered in one task, where its turns differ; ids that are joined up in one task, where they lie close.
CHUNK, IDS = 256, 4096
_WORDS = r"[^\x20\x09-\x0D]+"


def taken_over(conv_id: Column) -> Column:
    """h: how many turns a conversation takes over."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def numbered(rows: DataFrame, key: str, chunk: Column, order: Sequence[Column]) -> DataFrame:
    """Adds rank (from 1, by chunk, then order) and last (the rank of the key's last row). A key is numbered chunk by chunk, so that a long one is split."""
    w = Window.partitionBy(key).orderBy("_chunk")
    rows = rows.withColumn("_chunk", chunk)
    counts = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col(key).alias("_key"), F.col("_chunk").alias("_part"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("last"))
    within = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order)))
    out = within.join(starts, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_part")))
    return out.withColumn("rank", F.col("_before") + F.col("_place")).drop("_key", "_part", "_before", "_place")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, rank, last, words and two hashes (t1, t2) of each turn's role and text, in their order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn"),
        F.xxhash64(F.lit(1), text("role"), text("text")).alias("t1"),
        F.xxhash64(F.lit(2), text("role"), text("text")).alias("t2"),
        F.regexp_count(text("text"), F.lit(_WORDS)).cast("long").alias("words"),
    )
    # equal turns are alike for all that follows, and the hashes order those of one number
    chunk = F.floor(F.col("turn") / CHUNK)
    return numbered(rows.withColumn("turn", F.coalesce("turn", F.lit(-(2**62)))), "conv_id", F.coalesce(chunk, F.lit(-(2**62))), [F.col("turn"), F.col("t1"), F.col("t2")]).drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), length, words, t1, t2 of every rebuilt conversation, and a row of depth 0 for each."""
    base = F.col("conv_id") - F.col("conv_id") % NEIGHBOURS
    term = F.struct("rank", "t1", "t2", "words")
    heads = turns.where((F.col("conv_id") % NEIGHBOURS == 0) & (F.col("rank") <= HEAD)).groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(term)).alias("head"))
    every = turns.where("rank = 1").select("conv_id", "last").withColumn("h", taken_over(F.col("conv_id"))).withColumn("_at", base)
    every = every.join(heads, F.col("_at") == F.col("_base"), "left").withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    length = (F.col("k") + F.greatest(F.lit(0), F.col("last") - F.col("h"))).alias("length")
    start = F.array(F.struct(*(F.lit(0).cast("long").alias(c) for c in ("rank", "t1", "t2", "words"))))
    first = every.select("conv_id", length, F.explode(F.concat(start, F.when(F.col("k") > 0, F.slice("head", 1, F.col("k"))).otherwise(F.array()))).alias("t"))
    first = first.select("conv_id", F.col("t.rank").alias("depth"), "length", "t.words", "t.t1", "t.t2")
    own = turns.withColumn("h", taken_over(F.col("conv_id"))).where(F.col("rank") > F.col("h")).withColumn("_at", base)
    own = own.join(heads.select("_base", F.size("head").alias("_n")), F.col("_at") == F.col("_base"), "left").withColumn("k", F.least("h", F.coalesce("_n", F.lit(0))))
    return first.union(own.select("conv_id", (F.col("k") + F.col("rank") - F.col("h")).alias("depth"), length, "words", "t1", "t2"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, words, ends, node, parent: a node's name is a hash of two sums of hashes of its turns and their places, so that a long conversation is summed in chunks."""
    terms = {s: F.when(F.col("depth") > 0, F.xxhash64(F.lit(s), "depth", "t1", "t2")).otherwise(0).cast("decimal(20,0)") for s in ("s1", "s2")}
    rows = rows.select("conv_id", "depth", "words", (F.col("depth") == F.col("length")).alias("ends"), F.floor(F.col("depth") / CHUNK).alias("_chunk"), *(t.alias(s) for s, t in terms.items()))
    sums = rows.groupBy("conv_id", "_chunk").agg(*(F.sum(s).alias(f"_{s}") for s in terms))
    w = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("conv_id").alias("_key"), F.col("_chunk").alias("_part"), *(F.coalesce(F.sum(f"_{s}").over(w), F.lit(0)).alias(f"_{s}") for s in terms))
    within = Window.partitionBy("conv_id", "_chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *(F.sum(s).over(within).alias(f"r{s}") for s in terms)).join(before, (F.col("conv_id") == F.col("_key")) & (F.col("_chunk") == F.col("_part")))

    def name(depth: Column, less: bool) -> Column:
        sums = [F.col(f"_{s}") + F.col(f"r{s}") - (F.col(s) if less else F.lit(0)) for s in terms]
        return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *(x.cast("string") for x in sums))))

    d = F.col("depth")
    return run.select("conv_id", "depth", "words", "ends", name(d, False).alias("node"), F.when(d > 0, name(d - 1, True)).alias("parent"))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """node, parent, depth, conv_id (least member), n_convs, own (what sharing its last turn saves)."""
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    return nodes.select("node", "parent", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))


def end_hashes(rows: DataFrame) -> DataFrame:
    """_end and ends_sha256 of nodes at which conversations end. Ids are joined up by ranges of them first, so that a node of many meets as few rows."""
    chunks = rows.where("ends").groupBy("node", F.floor(F.col("conv_id") / IDS).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    lists = chunks.groupBy(F.col("node").alias("_end")).agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("x"))
    return lists.select("_end", F.sha2(F.array_join("x.ids", ","), 256).alias("ends_sha256"))


def _follow(chain: DataFrame) -> DataFrame:
    """chain: node, child (its one unfinished child), leaves, saved. Returns it with child as the first node below that is not in chain, and the sums on the way there, by pointer doubling. Each written table is the last one's successor."""
    now = materialize(chain.select("node", F.col("child").alias("to"), "leaves", "saved"), "trie-chain")
    while True:
        ahead = now.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
        joined = now.join(ahead, F.col("to") == F.col("_n"), "left")
        new = materialize(joined.select("node", F.coalesce("_to", "to").alias("to"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), F.col("_n").isNotNull().alias("moved")), "trie-chain")
        discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens of every node. nodes: node, parent, n_convs, n_children, own.

    open: nodes that wait, with what has reached them so far, the number of children they wait for, and the nearest
    waiting ancestor with what lies between (carry). done: finished nodes. folded: nodes of chains by round, which take
    over the totals of the node they lead to.
    """
    alone = (F.col("n_convs") == 1).alias("alone")
    every = nodes.select("node", "parent", "n_children", "own", alone)
    done = [every.where("alone").select("node", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))]
    # paths of one member each finish at once; their tops are heard by nodes that are shared
    zero = F.lit(0).cast("long")
    shared = every.where("not alone").select("node", "parent", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").alias("saved"), zero.alias("carry_leaves"), zero.alias("carry_saved"))
    tops = every.where("alone").select(F.col("parent").alias("_p")).groupBy("_p").agg(F.count("*").alias("_c"))
    heard = shared.join(tops, F.col("node") == F.col("_p"), "left")
    got = F.coalesce("_c", zero)
    open_ = materialize(heard.select("node", "parent", (F.col("n_children") - got).alias("waits"), (F.col("leaves") + got).alias("leaves"), "saved", "carry_leaves", "carry_saved"), "trie-open")
    folded, written = [], []
    while not open_.isEmpty():
        # a completed node says what its parent gains: its subtree and what was folded between the two
        complete = open_.where("waits = 0")
        done.append(materialize(complete.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "trie-done"))
        messages = complete.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_c"), F.sum(F.col("leaves") + F.col("carry_leaves")).alias("_l"), F.sum(F.col("saved") + F.col("carry_saved")).alias("_s"))
        left = open_.where("waits > 0").join(messages, F.col("node") == F.col("_p"), "left")
        add = lambda c, m: (F.col(c) + F.coalesce(m, zero)).alias(c)
        rest = materialize(left.select("node", "parent", (F.col("waits") - F.coalesce("_c", zero)).alias("waits"), add("leaves", "_l"), add("saved", "_s"), "carry_leaves", "carry_saved"), "trie-open")
        written.append(open_)
        # nodes that wait for one child lead to it: they take over its totals, and what they hold becomes its carry
        waiting = rest.where("waits = 1").select(F.col("node").alias("_v"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
        links = rest.select(F.col("node").alias("child"), "parent", "carry_leaves", "carry_saved").join(waiting, F.col("parent") == F.col("_v"))
        chain = _follow(links.select(F.col("_v").alias("node"), "child", (F.col("_l") + F.col("carry_leaves")).alias("leaves"), (F.col("_s") + F.col("carry_saved")).alias("saved")))
        if not chain.isEmpty():
            folded.append(chain)
            in_chain = chain.select(F.col("node").alias("_v"), F.col("to").alias("_to"), F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
            # the top of a chain is the member whose parent is in none; its end hangs below that parent
            members = rest.where("waits = 1").select("node", F.col("parent").alias("_up"), F.col("carry_leaves").alias("_cl"), F.col("carry_saved").alias("_cs")).join(in_chain, F.col("node") == F.col("_v")).drop("node")
            above = chain.select(F.col("node").alias("_a"))
            tops = members.join(above, F.col("_up") == F.col("_a"), "left_anti")
            ends = rest.join(in_chain.select("_v"), F.col("node") == F.col("_v"), "left_anti").join(tops, F.col("node") == F.col("_to"), "left")
            moved = F.col("_v").isNotNull()
            kept = ends.select("node", F.when(moved, F.col("_up")).otherwise(F.col("parent")).alias("parent"), "waits", "leaves", "saved", F.when(moved, F.col("_l") + F.col("_cl")).otherwise(F.col("carry_leaves")).alias("carry_leaves"), F.when(moved, F.col("_s") + F.col("_cs")).otherwise(F.col("carry_saved")).alias("carry_saved"))
            open_ = materialize(kept, "trie-open")
            written.append(rest)
        else:
            discard(chain)
            open_ = rest
    written.append(open_)
    discard(*written)
    totals = _union(done)
    for chain in reversed(folded):
        ends = totals.select(F.col("node").alias("_e"), "n_leaves", "saved_tokens")
        more = chain.join(ends, F.col("to") == F.col("_e")).select("node", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"))
        totals = totals.union(materialize(more, "trie-done"))
    discard(*folded)
    return totals


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of rebuilt conversations.

    Turns are ordered by number, null first; turns of one number by a hash of role and text; repeated rows are turns of
    their own. A null role or text is the empty one. Rows with a null conv_id belong to no conversation. Without
    conversations there is no node, not even the root. Other columns are ignored. Names of nodes are 128-bit hashes.
    A node's saving is its words times its members but one, added up over its subtree.
    """
    turns = materialize(turns_of(conversations), "trie-turns")
    rows = materialize(prefixes(rebuilt(turns)), "trie-rows")
    discard(turns)
    nodes = trie_nodes(rows)
    children = nodes.groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, F.col("node") == F.col("_p"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("_p")
    nodes = materialize(counted, "trie-nodes")
    totals = subtree_totals(nodes).withColumnRenamed("node", "_t")
    up = nodes.where("n_children > 0").select(F.col("node").alias("_u"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_hashes(rows)
    out = nodes.join(totals, F.col("node") == F.col("_t")).join(ends, F.col("node") == F.col("_end"), "left").join(up, F.col("parent") == F.col("_u"), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
