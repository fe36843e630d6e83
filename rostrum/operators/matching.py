"""Fuzzy matching of names and texts, evaluation of an extraction, near-duplicates.

Comparisons never run over all pairs. Names are compared as distinct keys and
candidates come from equi joins: two names within edit distance k share at
least one of k+1 segments near the same position, so that join finds every
match; only the few names of a small transcript are compared directly. Only
names that match are joined back to rows. Texts meet in a set-similarity join,
and 1:1 pairs are found in rounds over rows and, for what the first round
leaves of a transcript, row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.groups import party_compare_key
from rostrum.functions.text import match_name_key
from rostrum.operators.common import count_if, distributed_rank, ratio
from rostrum.operators.similar import jaccard, similar_sets, with_shingles
from rostrum.session import materialize

NAME_DISTANCE = 3
# Distinct names a side up to which the names of a block are compared pair by pair.
PAIRED_NAMES = 64
# Rows and options of a block that one task serves after the first round.
SERVED_ROWS = 100_000
# Rounds whose pairs are put together, so that the plan stays small however many rounds follow.
ROUNDS = 16
PARTIAL_SIMILARITY = 0.5
PARTIAL_WORDS = 2
DUPLICATE_SIMILARITY = 0.8
DUPLICATE_WORDS = 5


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance; with a ``limit`` larger distances give -1 and cost less."""
    return F.levenshtein(a, b) if limit is None else F.levenshtein(a, b, limit)


def _last_token(key: Column) -> Column:
    return F.element_at(F.split(key, " "), -1)


def names_match(a: Column, b: Column, threshold: int = NAME_DISTANCE) -> Column:
    """Equal keys, keys within ``threshold`` edits, or the same last token."""
    return keys_match(match_name_key(a), match_name_key(b), threshold)


def keys_match(ka: Column, kb: Column, threshold: int = NAME_DISTANCE) -> Column:
    """The same for name keys."""
    near = F.levenshtein(ka, kb, threshold) >= 0
    return (ka == kb) | near | ((ka != "") & (kb != "") & (_last_token(ka) == _last_token(kb)))


def text_similarity(a: Column, b: Column) -> Column:
    """Shared part (Jaccard) of two arrays of shingles from :func:`rostrum.operators.similar.with_shingles`; 0 for empty ones."""
    return jaccard(a, b)


# ---------------------------------------------------------------- name candidates


def _segments(key: Column, parts: int) -> Column:
    """``(start, segment)`` of a string cut into ``parts`` nearly equal pieces (longer ones last)."""
    n = F.length(key)
    short = F.floor(n / parts).cast("int")
    longer = (n - short * parts).cast("int")

    def piece(i: Column) -> Column:
        extra = F.greatest(F.lit(0), i - (F.lit(parts) - longer))
        start = i * short + extra
        size = short + F.when(i >= F.lit(parts) - longer, 1).otherwise(0)
        return F.struct(i.cast("int").alias("seg"), F.substring(key, start + 1, size).alias("text"), start.cast("int").alias("start"), size.cast("int").alias("size"))

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), piece)


def matching_names(left: DataFrame, right: DataFrame, block: str, threshold: int = NAME_DISTANCE) -> DataFrame:
    """All pairs ``(block, left_key, right_key)`` of distinct name keys of a block that match (see ``names_match``).

    ``left`` and ``right`` hold ``(block, key)``. In a block of at most :data:`PAIRED_NAMES` names a side, names are
    compared as they are, which costs less than cutting them; in larger blocks candidates come from equi joins.
    """
    l = materialize(left.select(block, F.col("key").alias("left_key")).distinct())
    r = materialize(right.select(block, F.col("key").alias("right_key")).distinct())
    sizes = l.groupBy(block).count().unionByName(r.groupBy(block).count())
    many = materialize(sizes.filter(F.col("count") > PAIRED_NAMES).select(block).distinct())
    matches = keys_match(F.col("left_key"), F.col("right_key"), threshold)
    if many.isEmpty():
        return l.join(r, block).filter(matches)
    few = l.join(many, block, "left_anti").join(r, block).filter(matches)
    candidates = _name_candidates(l.join(many, block, "left_semi"), r.join(many, block, "left_semi"), block, threshold)
    return few.unionByName(candidates.filter(matches))


def _name_candidates(l: DataFrame, r: DataFrame, block: str, threshold: int) -> DataFrame:
    """Distinct pairs ``(block, left_key, right_key)`` that contain all matches.

    Three equi joins find them: equal last token; for keys longer than ``threshold``, one of
    ``threshold + 1`` segments at a position shifted by at most ``threshold``;
    and for the few shorter keys, the length.
    """
    lt = l.filter(F.col("left_key") != "").withColumn("_t", _last_token(F.col("left_key")))
    rt = r.filter(F.col("right_key") != "").withColumn("_t", _last_token(F.col("right_key")))
    by_last = lt.join(rt, [block, "_t"]).select(block, "left_key", "right_key")

    parts = threshold + 1
    ls = l.filter(F.length("left_key") > threshold).select(
        block, "left_key", F.length("left_key").alias("_n"), F.inline(_segments(F.col("left_key"), parts))
    ).withColumnRenamed("text", "_g")
    shifts = F.sequence(F.lit(-threshold), F.lit(threshold))
    sizes = F.explode(F.sequence(F.length("right_key") - threshold, F.length("right_key") + threshold)).alias("_n")
    rn = r.filter(F.length("right_key") > 0).select(block, "right_key", sizes).filter(F.col("_n") > threshold)
    # the segments of a left key of length _n have known starts and sizes
    shape = F.inline(F.transform(_segments(F.repeat(F.lit("x"), F.col("_n")), parts), lambda s: F.struct(s["seg"], s["start"], s["size"])))
    rs = (
        rn.select(block, "right_key", "_n", shape)
        .select(block, "right_key", "_n", "seg", "size", F.explode(F.transform(shifts, lambda d: F.col("start") + d)).alias("_at"))
        .filter((F.col("_at") >= 0) & (F.col("_at") + F.col("size") <= F.length("right_key")))
        .select(block, "right_key", "_n", "seg", F.substring("right_key", F.col("_at") + 1, F.col("size")).alias("_g"))
        .distinct()
    )
    by_segment = ls.select(block, "left_key", "_n", "seg", "_g").join(rs, [block, "_n", "seg", "_g"]).select(block, "left_key", "right_key")

    # keys of at most ``threshold`` characters: few distinct strings, joined on every admissible length
    tiny = l.filter(F.length("left_key") <= threshold).select(
        block, "left_key", F.explode(F.sequence(F.lit(0), F.length("left_key") + threshold)).alias("_n")
    )
    by_length = tiny.join(r.withColumn("_n", F.length("right_key")), [block, "_n"]).select(block, "left_key", "right_key")

    return by_last.union(by_segment).union(by_length).distinct()


# ---------------------------------------------------------------- matching truth and prediction


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_name", match_name_key(F.col("speaker"))).withColumn("_party", party_compare_key(F.col("party")))


def assign_in_order(left: DataFrame, right: DataFrame, options: DataFrame, block: str) -> DataFrame:
    """1:1 pairs ``(block, l_idx, r_idx)``: left rows in order of ``l_idx`` each take their best free right row.

    ``left(block, l_idx, l_class)`` and ``right(block, r_idx, r_class)`` name the class of each row;
    ``options(block, l_class, r_class, pref)`` says which classes may be paired. The smallest ``pref`` is best, then
    the smallest ``r_idx``. Indexes are unique within a block.

    The order of service is resolved in rounds over rows on reliable storage. Left classes with the same options are
    one class first. In a round the k-th waiting row of a class aims at the k-th free row of its list, which is the best it can
    still get. It gets it unless the first waiting row of another class comes before it and aims there or at something
    it likes better; then it and the rest of its class wait. Rows whose list is exhausted stay alone. One round
    settles all classes that share nothing. What is left of a block, rows and options without texts, is then served row
    by row in one task (:func:`_serve_blocks`), so the number of jobs does not depend on how classes are tangled;
    only where more than :data:`SERVED_ROWS` are left, rounds go on, each of which settles at least the first waiting row of every knot.
    """
    choice = F.sort_array(F.collect_list(F.struct("pref", "r_class")))
    lists = options.groupBy(block, "l_class").agg(F.md5(F.to_json(choice)).alias("_list"))
    merged = materialize(options.join(lists.groupBy(block, "_list").agg(F.min("l_class").alias("l_class")), [block, "l_class"]).select(block, "_list", "r_class", "pref"))
    waiting = materialize(left.join(lists, [block, "l_class"]).select(block, "_list", "l_idx"))
    free = right.select(block, "r_class", "r_idx")
    done = []
    while not waiting.isEmpty():
        aims = distributed_rank(waiting, [block, "_list"], [F.asc("l_idx")], "_k")
        goods = distributed_rank(free.join(merged, [block, "r_class"]), [block, "_list"], [F.asc("pref"), F.asc("r_idx")], "_k")
        aimed = materialize(aims.join(goods, [block, "_list", "_k"]))
        heads = aimed.filter("_k = 1").select(block, F.col("_list").alias("_other"), F.col("l_idx").alias("_head"), F.struct("pref", "r_idx").alias("_head_aim"))
        rivals = merged.select(block, "r_class", F.col("_list").alias("_other"), F.col("pref").alias("_their_pref"))
        ahead = (F.col("_other") != F.col("_list")) & (F.col("_head") < F.col("l_idx")) & (F.col("_head_aim") <= F.struct(F.col("_their_pref").alias("pref"), "r_idx"))
        stopped = aimed.join(rivals, [block, "r_class"]).join(heads, [block, "_other"]).filter(ahead).groupBy(block, "_list").agg(F.min("l_idx").alias("_stop"))
        told = materialize(aimed.join(stopped, [block, "_list"], "left").select(block, "l_idx", "r_idx", (F.col("_stop").isNull() | (F.col("l_idx") < F.col("_stop"))).alias("_gets")))
        got = told.filter("_gets").select(block, "l_idx", "r_idx")
        done.append(got)
        if len(done) == ROUNDS:
            done = [materialize(reduce(DataFrame.unionByName, done))]
        waiting = materialize(waiting.join(told.filter("NOT _gets").select(block, "l_idx"), [block, "l_idx"], "left_semi"))
        free = materialize(free.join(got.select(block, "r_idx"), [block, "r_idx"], "left_anti"))
        if len(done) == 1 and not waiting.isEmpty():
            pairs, large = _serve_blocks(waiting, free, merged, block)
            done.append(pairs)
            waiting, free = (materialize(df.join(large, block, "left_semi")) for df in (waiting, free))
    if not done:
        return waiting.select(block, "l_idx", F.col("l_idx").alias("r_idx"))
    return reduce(DataFrame.unionByName, done)


def _serve_blocks(waiting: DataFrame, free: DataFrame, options: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of the blocks with at most :data:`SERVED_ROWS` waiting rows, options and rows they can get, and the other blocks."""
    none = {"idx": F.lit(None).cast("long"), "_list": F.lit(None).cast("string"), "r_class": F.lit(None).cast("string"), "pref": F.lit(None).cast("double")}
    entry = lambda df, **cols: df.select(block, *[{**none, **cols}[c].alias(c) for c in none])
    wanted = options.join(waiting.select(block, "_list").distinct(), [block, "_list"], "left_semi")
    able = free.join(wanted.select(block, "r_class").distinct(), [block, "r_class"], "left_semi")
    entries = entry(waiting, idx=F.col("l_idx"), _list=F.col("_list")).unionByName(entry(able, idx=F.col("r_idx"), r_class=F.col("r_class")))
    entries = materialize(entries.unionByName(entry(wanted, _list=F.col("_list"), r_class=F.col("r_class"), pref=F.col("pref"))))
    large = materialize(entries.groupBy(block).count().filter(F.col("count") > SERVED_ROWS).select(block))

    def serve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pairs = _serve(*(table[c].to_pylist() for c in ("idx", "_list", "r_class", "pref")))
        columns = [pa.array([key[0].as_py()] * len(pairs), key[0].type), *(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))]
        return pa.Table.from_arrays(columns, [block, "l_idx", "r_idx"])

    kind = waiting.schema[block].dataType.simpleString()
    small = entries.join(large, block, "left_anti")
    return small.groupBy(block).applyInArrow(serve, f"`{block}` {kind}, l_idx long, r_idx long"), large


def _serve(idx: list, l_class: list, r_class: list, pref: list) -> list[tuple[int, int]]:
    """Pairs of one block. A left row has an index and a left class, a right row an index and a right class,
    an option both classes.

    Rows of a right class are taken in order, so a class stands for its first free row. Each left class keeps its options
    in a heap by (pref, first free row); an entry that is out of date is put back when it comes up.
    """
    rows, free, heaps = [], {}, {}
    for i, l, r, p in zip(idx, l_class, r_class, pref, strict=True):
        if r is None:
            rows.append((i, l))
        elif l is None:
            free.setdefault(r, []).append(i)
    for waiting in free.values():
        waiting.sort(reverse=True)
    for i, l, r, p in zip(idx, l_class, r_class, pref, strict=True):
        if i is None and r in free:
            heaps.setdefault(l, []).append((p, free[r][-1], r))
    for heap in heaps.values():
        heapify(heap)
    pairs = []
    for i, l in sorted(rows):
        heap = heaps.get(l, [])
        while heap:
            p, at, r = heap[0]
            if free[r] and free[r][-1] == at:
                pairs.append((i, free[r].pop()))
                break
            if free[r]:
                heapreplace(heap, (p, free[r][-1], r))
            else:
                heappop(heap)
    return pairs


def match_exact(truth: DataFrame, pred: DataFrame, block: str = "protocol_id") -> DataFrame:
    """1:1 pairs ``(block, truth_idx, pred_idx)`` by matching name and equal party (or an official without party).

    Truth rows are served in order and take the first free prediction. Rows of equal (name, party, role) form classes,
    so names are compared as classes and rows are paired by rank (:func:`assign_in_order`).
    """
    t, p = _keyed(truth), _keyed(pred)
    official = F.coalesce(F.col("role"), F.lit("")) != ""
    t = t.withColumn("_free", official & (F.col("_party") == ""))
    names = matching_names(t.select(block, F.col("_name").alias("key")), p.select(block, F.col("_name").alias("key")), block)
    l_class = F.concat_ws("\u0001", "_name", "_party", F.col("_free").cast("string"))
    r_class = F.concat_ws("\u0001", "_name", "_party")
    left = t.select(block, F.col("idx").cast("long").alias("l_idx"), l_class.alias("l_class"))
    right = p.select(block, F.col("idx").cast("long").alias("r_idx"), r_class.alias("r_class"))
    lc = t.select(block, F.col("_name").alias("left_key"), F.col("_party").alias("_tp"), "_free", l_class.alias("l_class")).distinct()
    rc = p.select(block, F.col("_name").alias("right_key"), F.col("_party").alias("_pp"), r_class.alias("r_class")).distinct()
    options = lc.join(names, [block, "left_key"]).join(rc, [block, "right_key"]).filter((F.col("_tp") == F.col("_pp")) | F.col("_free"))
    options = materialize(options.select(block, "l_class", "r_class", F.lit(0.0).alias("pref")))
    return assign_in_order(left, right, options, block).select(block, F.col("l_idx").alias("truth_idx"), F.col("r_idx").alias("pred_idx"))


def match_partial(
    truth: DataFrame, pred: DataFrame, block: str = "protocol_id", threshold: float = PARTIAL_SIMILARITY, chars: int | None = None, words: int = PARTIAL_WORDS
) -> DataFrame:
    """1:1 pairs of the remaining rows by text similarity above ``threshold``, best prediction first.

    The similarity is the Jaccard share of runs of ``words`` words of the whole texts; where ``text_preview`` is only
    the head of a text, ``chars`` gives its length. Texts with the same runs are one class, classes meet in a
    set-similarity join within their transcript, and rows are paired by rank. The result says whether the names agree.
    """
    def prepared(df: DataFrame, text: str) -> DataFrame:
        head = F.col(text) if chars is None else F.substring(text, 1, chars)
        rows = with_shingles(df.select(block, F.col("idx").cast("long").alias("idx"), "speaker", head.alias("_head")), F.col("_head"), words).drop("_head")
        # two texts are one class if they have the same runs
        return materialize(rows.withColumn("shingles", F.sort_array("shingles")).withColumn("id", F.md5(F.to_json("shingles"))))

    l, r = prepared(truth, "text_preview"), prepared(pred, "text")
    sets = [s.dropDuplicates([block, "id"]).select(block, "id", "shingles") for s in (l, r)]
    scored = similar_sets(*sets, block, threshold, strict=True)
    options = materialize(scored.select(block, F.col("left_id").alias("l_class"), F.col("right_id").alias("r_class"), (-F.col("similarity")).alias("pref")))
    left = l.select(block, F.col("idx").alias("l_idx"), F.col("id").alias("l_class"), F.col("speaker").alias("l_speaker"))
    right = r.select(block, F.col("idx").alias("r_idx"), F.col("id").alias("r_class"), F.col("speaker").alias("r_speaker"))
    chosen = assign_in_order(left, right, options, block).join(left, [block, "l_idx"]).join(right, [block, "r_idx"]).join(options, [block, "l_class", "r_class"])
    return chosen.select(
        block, F.col("l_idx").alias("truth_idx"), F.col("r_idx").alias("pred_idx"), (-F.col("pref")).alias("similarity"),
        names_match(F.col("l_speaker"), F.col("r_speaker")).alias("same_speaker"),
    )


def match_all(truth: DataFrame, pred: DataFrame, block: str = "protocol_id", chars: int | None = None) -> DataFrame:
    """Labelled matches ``(block, truth_idx, pred_idx, match_type, similarity, same_speaker)``.

    ``match_type`` is exact, partial, truth_only or pred_only; ``chars`` as in :func:`match_partial`.
    """
    t = truth.withColumn("idx", F.col("idx").cast("long"))
    p = pred.withColumn("idx", F.col("idx").cast("long"))
    exact = materialize(match_exact(t, p, block))

    def rest(df: DataFrame, found: DataFrame, idx: str) -> DataFrame:
        return df.join(found.select(block, F.col(idx).alias("idx")), [block, "idx"], "left_anti")

    t1, p1 = rest(t, exact, "truth_idx"), rest(p, exact, "pred_idx")
    partial = materialize(match_partial(t1, p1, block, chars=chars))
    t2, p2 = rest(t1, partial, "truth_idx"), rest(p1, partial, "pred_idx")
    nul_d, nul_b, nul_l = F.lit(None).cast("double"), F.lit(None).cast("boolean"), F.lit(None).cast("long")
    return (
        exact.select(block, "truth_idx", "pred_idx", F.lit("exact").alias("match_type"), nul_d.alias("similarity"), nul_b.alias("same_speaker"))
        .unionByName(partial.withColumn("match_type", F.lit("partial")))
        .unionByName(t2.select(block, F.col("idx").alias("truth_idx"), nul_l.alias("pred_idx"), F.lit("truth_only").alias("match_type"), nul_d.alias("similarity"), nul_b.alias("same_speaker")))
        .unionByName(p2.select(block, nul_l.alias("truth_idx"), F.col("idx").alias("pred_idx"), F.lit("pred_only").alias("match_type"), nul_d.alias("similarity"), nul_b.alias("same_speaker")))
    )


def detection_metrics(matches: DataFrame, block: str = "protocol_id") -> DataFrame:
    """Counts, precision, recall and F1 per block and overall (block null); 0 where a denominator is 0."""
    m = F.col("match_type")
    per_block = matches.groupBy(block).agg(
        *[count_if(m == k).alias(k) for k in ("exact", "partial", "truth_only", "pred_only")],
        count_if((m == "partial") & ~F.coalesce(F.col("same_speaker"), F.lit(True))).alias("speaker_mismatches"),
    )
    counted = per_block.rollup(block).agg(
        *[F.sum(c).alias(c) for c in ("exact", "partial", "truth_only", "pred_only", "speaker_mismatches")],
        (F.grouping(block) == 1).alias("overall"),
    )
    found = F.col("exact") + F.col("partial")
    precision = ratio(found, found + F.col("pred_only"))
    recall = ratio(found, found + F.col("truth_only"))
    return counted.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", ratio(2 * (F.col("precision") * F.col("recall")), F.col("precision") + F.col("recall"))
    )


def match_issues(matches: DataFrame, truth: DataFrame, pred: DataFrame, block: str = "protocol_id") -> DataFrame:
    """One readable line per match that is not exact."""
    t = truth.select(block, F.col("idx").cast("long").alias("truth_idx"), F.col("speaker").alias("_ts"), F.coalesce("party", "role").alias("_tp"))
    p = pred.select(block, F.col("idx").cast("long").alias("pred_idx"), F.col("speaker").alias("_ps"), F.col("party").alias("_pp"))
    issue = (
        F.when(F.col("match_type") == "truth_only", F.format_string("missed: %s (%s)", "_ts", "_tp"))
        .when(F.col("match_type") == "pred_only", F.format_string("unconfirmed: %s (%s)", "_ps", "_pp"))
        .when(~F.col("same_speaker"), F.format_string("speaker mismatch: %s vs %s", "_ts", "_ps"))
        .otherwise(F.format_string("matched by text similarity (%.0f%%)", F.col("similarity") * 100))
    )
    return (
        matches.filter(F.col("match_type") != "exact")
        .join(t, [block, "truth_idx"], "left")
        .join(p, [block, "pred_idx"], "left")
        .select(block, "truth_idx", "pred_idx", issue.alias("issue"))
    )


# ---------------------------------------------------------------- near duplicates


def near_duplicates(
    df: DataFrame, block: str = "protocol_id", id_col: str = "speech_id", speaker: str = "speaker", text: str = "text",
    threshold: float = DUPLICATE_SIMILARITY, chars: int | None = None, words: int = DUPLICATE_WORDS,
) -> DataFrame:
    """Pairs of different texts of matching speakers in a block with a similarity of ``threshold`` or more.

    The similarity is the Jaccard share of runs of ``words`` words of the whole texts, or of their first ``chars``
    characters if that is given. Copies with the same speaker and the same text form one class, represented by its smallest id;
    ``n_left`` and ``n_right`` are the class sizes, so a class of a million copies is one row (``pairs`` counts
    the row pairs it stands for). A class with several copies is also listed against itself with similarity 1.
    Classes meet in a set-similarity join, and names are compared on its pairs. Empty texts are left out.
    """
    head = F.col(text) if chars is None else F.substring(text, 1, chars)
    keyed = with_shingles(df.select(block, F.col(id_col).alias("_id"), match_name_key(F.col(speaker)).alias("_name"), head.alias("_head")).filter("_head <> ''"), F.col("_head"), words)
    keyed = keyed.select(block, "_name", F.sha2("_head", 256).alias("_text"), "_id", "shingles")
    classes = materialize(keyed.groupBy(block, "_name", "_text").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("_n"), F.first("shingles").alias("shingles")))
    copies = classes.filter(F.col("_n") > 1).select(
        block, F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("similarity"),
        F.col("_n").alias("n_left"), F.col("_n").alias("n_right"), (F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("pairs"),
    )
    found = similar_sets(classes.select(block, "id", "shingles"), None, block, threshold).select(block, "left_id", "right_id", "similarity")
    side = lambda tag: classes.select(block, F.col("id").alias(f"{tag}_id"), F.col("_name").alias(f"{tag}_name"), F.col("_n").alias(f"n_{tag}"))
    named = found.join(side("left"), [block, "left_id"]).join(side("right"), [block, "right_id"])
    different = named.filter(keys_match(F.col("left_name"), F.col("right_name"))).select(
        block, "left_id", "right_id", "similarity", "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("pairs")
    )
    return different.unionByName(copies)


def sample_protocols(protocols: DataFrame, n: int, seed: int = 0, key: str = "protocol_id", only: Sequence | None = None) -> DataFrame:
    """The protocols with the given ids, or the ``n`` with the smallest md5 of seed and id."""
    if only is not None:
        return protocols.filter(F.col(key).isin(*only))
    return protocols.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)).limit(n)
