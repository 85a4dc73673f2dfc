"""Benchmark questions: eligibility, near-duplicate groups, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.functions import text as T
from quarrybook.plans.components import connected_components
from quarrybook.plans.pairs import similar_candidates
from quarrybook.plans.staging import Staging

MAX_QUESTION_CHARS = 2000
#: Overlap of words, of papers beside similar words, and of papers alone, from which questions are related.
TEXT_SIMILAR, DOCS_SIMILAR, DOCS_SAME = 0.5, 0.3, 0.6


def eligibility_reason(q: str = "") -> Column:
    """The first rule that a raw question breaks, or null.

    Columns: type, body, exact_answer (array of items, each an array of
    variants), documents (array of addresses), snippets (array of structs with
    document, begin_section, end_section, begin, end, text).  A snippet rule is tested over all
    snippets before the next rule.
    """
    c = lambda name: F.col(q + name)
    none = lambda a: a.isNull() | (F.size(a) == 0)
    pmids = F.transform(c("documents"), T.pmid_from_url)
    blank = lambda v: v.isNull() | (F.trim(v) == "")
    malformed = F.exists(c("exact_answer"), lambda i: none(i) | F.exists(i, blank)) | ((c("type") == "factoid") & (F.size(c("exact_answer")) != 1))
    sections = F.exists(c("snippets"), lambda s: (s["begin_section"] != s["end_section"]) | ~s["begin_section"].isin("title", "abstract"))
    outside = F.exists(c("snippets"), lambda s: F.coalesce(~F.array_contains(pmids, T.pmid_from_url(s["document"])), F.lit(True)))
    broken = F.exists(c("snippets"), lambda s: (s["begin"] < 0) | (s["end"] < s["begin"]) | blank(s["text"]))
    return (
        F.when(F.coalesce(~c("type").isin("factoid", "list"), F.lit(True)), "out_of_scope_type")
        .when(F.length(F.trim(c("body"))) > MAX_QUESTION_CHARS, "question_too_long")
        .when(none(c("exact_answer")), "no_exact_answer")
        .when(malformed, "malformed_exact_answer")
        .when(none(c("documents")), "no_documents")
        .when(F.exists(pmids, lambda p: p.isNull()), "unparseable_document_url")
        .when(none(c("snippets")), "no_snippets")
        .when(sections, "full_text_snippet")
        .when(outside, "snippet_document_not_listed")
        .when(broken, "malformed_snippet")
    )


def related_pairs(questions: DataFrame, staging: Staging) -> DataFrame:
    """(a, b), a < b, of (id, body, pmids): equal word sets, or shared papers with the overlaps above.

    Related questions have equal word sets or share a paper, so those two keys find
    all candidates.  Each question of a word set is linked to the set's first.
    """
    sets = questions.select("id", T.word_set(F.col("body")).alias("words"), F.array_distinct("pmids").alias("pmids"))
    sets = staging.table(sets, "sets")
    first = sets.groupBy("words").agg(F.min("id").alias("a"))
    same = sets.join(first, "words").where(F.col("a") < F.col("id")).select("a", F.col("id").alias("b"))
    judged = paper_overlaps(sets, staging)
    alike = (F.col("docs") >= DOCS_SAME) | ((F.col("word_share") >= TEXT_SIMILAR) & (F.col("docs") >= DOCS_SIMILAR))
    return same.unionByName(judged.where(alike).select("a", "b")).distinct()


def paper_overlaps(sets: DataFrame, staging: Staging) -> DataFrame:
    """(a, b, word_share, docs) of (id, words, pmids): pairs with an overlap of papers of at least ``DOCS_SIMILAR``."""
    pairs = similar_candidates(sets.select("id", F.col("pmids").alias("values")), DOCS_SIMILAR, staging)
    side = lambda s: sets.select(F.col("id").alias(s), F.col("words").alias(f"w_{s}"), F.col("pmids").alias(f"p_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shares = both.select("a", "b", T.jaccard(F.col("w_a"), F.col("w_b")).alias("word_share"), T.jaccard(F.col("p_a"), F.col("p_b")).alias("docs"))
    return shares.where(F.col("docs") >= DOCS_SIMILAR)


def group_questions(questions: DataFrame) -> DataFrame:
    """(id, group_id): related questions in chains have one group, named by its least id."""
    staging = Staging(questions.sparkSession, "groups")
    links = staging.table(related_pairs(questions, staging), "links")
    parts = connected_components(links, staging, "a", "b", "cc-questions")
    return questions.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def seeded(seed: int, *parts: Column) -> Column:
    """A place in a shuffled order that depends on the seed and the parts alone."""
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def walk_quota(candidates: DataFrame, seed: int, per_type: int) -> tuple[DataFrame, DataFrame]:
    """((id, type), (id, group_id, type)) of (id, group_id, type, ok): the chosen, and the rejected, whose evidence failed.

    Groups are walked in seeded order, members too; a member is taken if its type
    is still open and it is ok, at most one of each group.  The walk goes from one closing of a type to the next:
    in between, each group's choice is its first ok member of an open type, so Spark picks
    the next ``per_type`` groups of each type, and the driver sees only as many rows as quotas.
    Raises if all groups do not suffice.
    """
    if per_type % 2:
        raise ValueError("per_type must be even")
    types = sorted(r[0] for r in candidates.select("type").distinct().limit(1001).collect())
    if len(types) > 1000:
        raise ValueError("more than 1000 types")
    ordered = candidates.withColumn("g", seeded(seed, F.col("group_id"))).withColumn("m", seeded(seed, F.col("group_id"), F.col("id")))
    ordered = Staging(candidates.sparkSession, "quota").table(ordered, "ordered")
    taken: dict[str, list[tuple]] = {t: [] for t in types}
    closed: dict[str, str] = {}
    done = ""
    while len(closed) < len(types):
        still = [t for t in types if t not in closed]
        first = ordered.where(F.col("ok") & (F.col("g") > done) & F.col("type").isin(still)).groupBy("g").agg(F.min(F.struct("m", "id", "type")).alias("x"))
        ranked = first.select("g", "x.*").withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("g")))
        needed = F.element_at(F.create_map(*[F.lit(v) for t in still for v in (t, per_type - len(taken[t]))]), F.col("type"))
        rows = sorted(ranked.where(F.col("k") <= per_type).where(F.col("k") <= needed).collect(), key=lambda r: r["g"])
        ends = {}
        for r in rows:
            if r["k"] == per_type - len(taken[r["type"]]):
                ends[r["type"]] = r["g"]
        if not ends:
            short = {t: per_type - len(taken[t]) - sum(r["type"] == t for r in rows) for t in still}
            raise ValueError(f"all groups examined; still short {short}")
        done = min(ends.values())
        for r in rows:
            if r["g"] <= done:
                taken[r["type"]].append((r["id"], r["type"], r["g"], r["m"]))
        closed |= {t: done for t, end in ends.items() if end == done}
    id_type = candidates.schema["id"].dataType.simpleString()
    chosen = candidates.sparkSession.createDataFrame([row for rows in taken.values() for row in rows], f"id {id_type}, type string, g string, m string")
    # the chosen are at most 1000 times per_type rows, the types 1000
    ends = candidates.sparkSession.createDataFrame(list(closed.items()), "type string, until string")
    walked = ordered.where(~F.col("ok") & (F.col("g") <= done)).join(F.broadcast(ends), "type").where("g <= until")
    beside = walked.join(chosen.select("g", F.col("m").alias("chosen")), "g", "left").where("chosen IS NULL OR m < chosen")
    return chosen.select("id", "type"), beside.select("id", "group_id", "type")


def select_quota(candidates: DataFrame, seed: int, per_type: int) -> DataFrame:
    """(id, type, split) of the chosen; see :func:`walk_quota`."""
    return split_in_half(walk_quota(candidates, seed, per_type)[0], seed)


def split_in_half(chosen: DataFrame, seed: int) -> DataFrame:
    """(id, type, split): half of each type, in seeded order, is for development."""
    w = Window.partitionBy("type")
    place = F.row_number().over(w.orderBy(seeded(seed, F.lit("split"), F.col("id"))))
    return chosen.select("id", "type", F.when(place <= F.floor(F.count("*").over(w) / 2), "development").otherwise("test").alias("split"))


def expand_with_neighbours(reference: DataFrame, neighbours: DataFrame, per_source: int = 3) -> DataFrame:
    """(pmid, origin): reference papers and each one's best neighbours; links into the set count toward the limit.

    ``reference``: (pmid); ``neighbours``: (pmid, neighbour, score).
    """
    w = Window.partitionBy("pmid").orderBy(F.col("score").desc(), "neighbour")
    best = neighbours.where("neighbour <> pmid").join(reference.distinct(), "pmid", "left_semi").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_source)
    related = best.select(F.col("neighbour").alias("pmid")).distinct().join(reference, "pmid", "left_anti")
    return reference.distinct().select("pmid", F.lit("reference").alias("origin")).unionByName(related.select("pmid", F.lit("related").alias("origin")))


def check_evidence(snippets: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, resolved, matched, reason) of (id, pmid, section, text): is any snippet verbatim in the field it names?"""
    beside = snippets.join(papers.select("pmid", "title", "abstract"), "pmid", "left")
    needle = T.squash(F.col("text"))
    field = F.when(F.col("section") == "title", F.col("title")).otherwise(F.col("abstract"))
    found = F.coalesce((needle != "") & F.contains(field, needle), F.lit(False))
    judged = beside.groupBy("id").agg(F.count_distinct(F.when(F.col("title").isNotNull(), F.col("pmid"))).alias("resolved"), F.count_if(found).alias("matched"))
    return judged.withColumn("reason", F.when(F.col("resolved") == 0, "no_paper_resolved").when(F.col("matched") == 0, "no_snippet_found_in_source_text"))
