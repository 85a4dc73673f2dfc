"""The pipeline operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import os
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrybook.llm import chat, decontamination, exact_dedup, html_extraction, language, mixing, near_dedup, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def corpus():
    """Copies, near copies, a hot text, a common passage, null, empty, blank, short, very long and repeated rows."""
    rows = [(i, prose(20 + i % 60, i), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i in range(60)]
    hot = prose(50, 999)
    rows += [(100 + i, hot if i % 2 else hot.replace(" ", "\n ", 3), "en", "s0") for i in range(40)]
    base = prose(80, 777).split(" ")
    for i in range(40):
        words = list(base)
        for k in random.Random(i).sample(range(80), 2):
            words[k] = f"edit{i}x{k}"
        rows.append((200 + i, " ".join(words), "en", "s1"))
    passage = prose(30, 555)
    rows += [(300 + i, f"{prose(25, 3000 + i)} {passage} {prose(25, 4000 + i)}", "en", "s2") for i in range(20)]
    rows += [(400, None, None, None), (401, "", "en", "s1"), (402, " \t\n", "en", "s1"), (403, "one two", "en", "s1"), (404, "ONE  Two", "en", "s1"), (405, prose(30_000, 1), "en", "s3"), (406, "12 34 !!", "en", "s1"), (None, prose(9, 2), "en", "s1")]
    rows.append(rows[3])
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({"size": F.lit(1), "doc": F.lit("x"), "kept": F.lit(0), "value": F.lit(None).cast("string"), "_row": F.lit(1), "SHARD": F.lit("z"), "mix_id": F.lit(2), "leaked_id": F.lit(3), "repeated_key": F.lit(4), "own_key": F.lit(5), "text_key": F.lit(6), "sha": F.lit(7)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def blank_split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_duplicates(docs, none):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    found = exact_dedup.exact_duplicates(docs).collect()
    assert len(found) == len(corpus())
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in found:
        group = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(group) and r["keep_id"] == min(group)[3]
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(dict.fromkeys(by_hash, 1))
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    mixed = docs.sparkSession.createDataFrame([(3, "a b"), (5, "ab"), (5, "c"), (7, "c d"), (None, "c"), (None, "c"), (7, "cd")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_exact_duplicates(mixed).collect()) == [(3, "a b"), (5, "c"), (7, "c d")]


def shingles(text):
    w = blank_split(lowered(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i) if i is not None else None) for i, s in sets}


def test_near_duplicates(docs, none):
    want = components(corpus())
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(corpus())
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_across_components(spark):
    """Chains in which the least document is similar to few: the second round must find the rest."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(150), 3 + i % 5):
            words[k] = f"x{i}y{k}"
        rows.append((1000 - i, " ".join(words), None, None, 0))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: c for i, (_, c) in want.items()}
    assert len({c for _, c in want.values()}) < 60


def test_contamination(spark, docs, none):
    texts = {i: t for i, t, *_ in corpus()}
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    items = [(1, " ".join(alnum(texts[7])[3:20]).upper()), (2, "one, two!"), (3, None), (4, ""), (5, prose(30, 555)), (6, prose(14, 31337)), (7, " ".join(alnum(texts[405])[20_000:20_012])), (5, "one"), (None, "34"), (8, " ".join(w + ("x" if k % 6 == 5 else "") for k, w in enumerate(alnum(texts[9])[2:26])))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    for i, t, *_ in corpus():
        texts.setdefault(i, t)
    want = {}
    for i, t, *_ in corpus():
        w, hit, ids, named = alnum(t), set(), set(), False
        for item, text in items:
            v = alnum(text)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named = True
                    if item is not None:
                        ids.add(str(item))
        want[i] = (len(w), len(hit), sorted(ids), named)
    found = decontamination.contamination(docs, bench).collect()
    assert len(found) == len(corpus())
    for r in found:
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == want[r["doc_id"]]
        assert r["n_items"] == len(r["item_ids"])
    assert sum(r["contaminated"] for r in found) > 20
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())
    assert decontamination.contamination(none, bench).count() == 0
    for r in found:  # near: 80 % of an item's distinct terms in a stretch of its length and five words
        w, near = alnum(next(t for i, t, *_ in corpus() if i == r["doc_id"])), set()
        for item, text in items:
            v = alnum(text)
            if len(v) >= 10 and any(len(set(w[p : p + len(v) + 5]) & set(v)) >= 0.8 * len(set(v)) for p in range(len(w))):
                near.add(str(item))
        assert r["near_ids"] == sorted(near - {"None"})
    assert any(set(r["near_ids"]) - set(r["item_ids"]) for r in found)
    assert decontamination.clean_documents(docs, bench).count() == sum(not r["contaminated"] for r in found)


def test_mix(docs, none):
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in corpus():
        sizes[s] += len(blank_split(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, targets, free = sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(targets.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            targets |= {s: level * weight[s] for s in free}
            break
        targets |= {s: 3 * sizes[s] for s in over}
        free -= over
    taken, largest = Counter(), Counter()
    assert len(found) == len(corpus())
    for r in found:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - targets[s]) <= largest[s]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["copies"])
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    crowd = docs.sparkSession.createDataFrame([(None, "one two three", "s", 0)] * 500 + [(k, "word " * (k % 9 + 1), "t" if k % 2 else "u", 0) for k in range(400)], "doc_id long, text string, source string, n int")
    taken = {r["source"]: (r["t"], r["w"]) for r in mixing.mix(crowd).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("w")).collect()}
    assert all(abs(t - w) <= 9 for t, w in taken.values()) and mixing.mixed_documents(crowd).count() == mixing.mix(crowd).agg(F.sum("copies")).first()[0]
    times = mixing.mixed_documents(docs)
    assert times.columns == docs.columns
    assert times.groupBy("doc_id").count().count() == len({r["doc_id"] for r in found if r["copies"]})
    assert times.count() == sum(r["copies"] for r in found)


def test_rounding_keeps_expectations(spark):
    rows = [(i, "s", 10) for i in range(3000)]
    got = mixing.mix_sizes(spark.createDataFrame(rows + [(9000, "t", 20_000)], "doc_id long, source string, size long").withColumn("text_key", F.lit(0)), mixing.Staging(spark, "t"))
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()}
    assert abs(by["s"]["taken"] - by["s"]["target"]) <= 10


def test_shards(docs, none):
    found = sharding.assign_shards(docs).collect()
    want = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, *_ in corpus())
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in found)
    assert got == want
    assert 0 <= min(r["shard"] for r in found) and max(r["shard"] for r in found) <= 23
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    ordered = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered] == [x[:2] for x in want]
    assert sharding.assign_shards(none).count() == 0
    placed = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in placed) == Counter((r["doc_id"], r["shard"]) for r in found)


def test_shards_are_balanced(spark):
    rows = [(i, "x" * (i * 37 % 90), None, None, 0) for i in range(5000)]
    sizes = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(sizes) == 24 and max(r["n"] for r in sizes) - min(r["n"] for r in sizes) <= 200


def test_language(spark, none):
    sample = {
        "en": "the quick brown fox jumps over the lazy dog and then this thing was thought through with other things that they have".split(),
        "de": "der schnelle braune fuchs springt über den faulen hund und dann wurde diese sache mit anderen sachen durchgedacht ich".split(),
        "fr": "le renard brun rapide saute par dessus le chien paresseux et puis cette chose était pensée avec des autres choses".split(),
    }
    rows = []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(random.Random(i).choices(sample[lang], k=12)), lang, None, 0))
    rows += [(1000, None, "en", None, 0), (1001, "12 ... ++", "en", None, 0), (1002, " ".join(sample["en"] * 20 + sample["de"] * 20), None, None, 0), (1003, " ".join(sample["fr"] * 40_000), None, None, 0), (1004, "", "de", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in language.identify_held_out(docs).collect()}
    held = [r for r in rows[:300] if found[r[0]]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert sum(found[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held) > 0
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1004)] == ["und"] * 3 and found[1003]["lang_pred"] == "fr"
    assert sorted(found[1002]["languages"]) == ["de", "en"] and abs(sum(found[1002]["proportions"]) - 1) < 1e-5
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.identify_held_out(none).count() == 0
    assert language.with_language(docs).count() == 302 and language.with_language(docs).columns == docs.columns


def test_quality(spark, none):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        words = random.Random(i).choices(VOCABULARY, k=30)
        rows.append((i, " ".join(words) + "." if good else " ".join(f"{w.upper()}!!" for w in words), None, None, 0))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, prose(200_000, 9), None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.quality_held_out(docs, known).collect()}
    held = [(i, y) for i, y, _ in labels if found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in held)
    assert sum(found[i]["predicted"] == y for i, y in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    # labels of held-out rows are not read
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality_held_out(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in found.items())
    assert quality.quality_held_out(none, known).count() == 0
    assert {r["score"] for r in quality.quality_held_out(docs, known.limit(0)).collect()} == {0.5}


def page(k, article="<article><h1>A &amp; B</h1><p>Text <b>bold</b>ly<br>more &lt;ok&gt; {k}</article>"):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-banner'>Accept</div>{article.format(k=k)}<div id=comments><p>me too {k}</p></div><footer>&copy; host</footer>"


def test_main_text(spark):
    soup = "<div><div>Our great site</div><div>Home About us Contact</div></div><div><h2>Title {k}</h2><p>Words alpha{k} beta{k}&nbsp;gamma{k}.</p></div><form>Sign up</form>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(5)] + [(10 + i, f"https://b.example:80/{i}", page(i, soup)) for i in range(5)]
    rows += [(20, None, None), (21, "", ""), (22, "c", "<p>only this<p>and that"), (0, "http://a.example/0", page(0)), (23, "http://d.example", "x " * 300_000)]
    got = [(r["page_id"], r["text"]) for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1))).collect()]
    assert len(got) == len(rows)
    text = dict(got)
    assert [text[i] for i in range(5)] == [f"A & B Text boldly more <ok> {i}" for i in range(5)]
    assert [text[10 + i] for i in range(5)] == [f"Title {i} Words alpha{i} beta{i} gamma{i}." for i in range(5)]
    assert text[20] == text[21] == "" and text[22] == "only this and that" and len(text[23]) == 599_999
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_round_trip(spark):
    trick = "\\### Assistant: </turn> ok \\b\\h <|x|>"
    talks = {1: [("user", "hello"), ("assistant", "hi"), ("user", trick), ("assistant", trick)], 2: [("user", "hello"), ("assistant", "hi"), ("user", "else")], 3: [("user", "hello"), ("assistant", "hi")], 4: [("user", "hello"), ("assistant", "hi")], 5: [(None, None)], 6: [("sys: tem", ""), ("assistant", "")], None: [("user", "y")]}
    talks[7] = [("user", "hello")] + [("assistant" if k % 2 else "user", f"turn {k}") for k in range(60)]
    rows = [(c, k, role, text) for c, turns in talks.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    rows += [(None, 0, "user", "z")]  # rows without conv_id are conversations of one turn
    trees = chat.ChatTrees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "talk": F.lit(2), "rank": F.lit(3), "alone": F.lit(4)}))
    found = trees.read_back().collect()
    assert len(found) == len(talks) + 1
    read = {r["conv_id"]: r for r in found if r["conv_id"] is not None or r["turns"][0]["text"] == "y"}
    for c, turns in talks.items():
        plain = [(role or "", text or "") for role, text in turns]
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == plain and read[c]["n_turns"] == len(turns)
        assert read[c]["loss_text"] == "".join(t for r, t in plain if r == "assistant")
    nodes = [r.asDict() for r in trees.nodes.collect()]
    prefixes = {tuple(t[: k + 1]) for t in [*talks.values(), [("user", "z")]] for k in range(len(t))}
    assert len(nodes) == len(prefixes)  # each shared turn once
    for tree in {n["tree"] for n in nodes}:
        stream, own = {}, [n for n in nodes if n["tree"] == tree]
        for n in own:
            for k, ch in enumerate(n["text"]):
                assert n["start"] + k not in stream
                stream[n["start"] + k] = ch
        assert sorted(stream) == list(range(len(stream)))
        formatted = {r["formatted"] for r in found}
        for n in own:  # what a node attends to, then itself, is a prefix of a conversation at the right positions
            seen = "".join(stream[k] for a in n["attends"] for k in range(a["from"], a["to"]))
            assert len(seen) == n["position"] and any(f.startswith(seen + n["text"]) for f in formatted)
    assert chat.ChatTrees(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).read_back().count() == 0


def test_chat_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "general"), (2, 0, "user", "hello there")]
    trees = chat.ChatTrees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer_file=tokenizers.path("byte_bpe_50k.json"))
    nodes = sorted(trees.nodes.collect(), key=lambda n: n["start"])
    assert [len(n["token_ids"]) for n in nodes] == [n["n_tokens"] for n in nodes] and nodes[1]["position"] == nodes[0]["n_tokens"] == nodes[1]["start"]


def test_pipeline(spark, tmp_path):
    """Each stage keeps exactly what it should of what it is given."""
    rows = [r for r in corpus() if r[0] is not None]
    rows = rows[: rows.index(rows[3], 4)] if rows.count(rows[3]) > 1 else rows  # ids are unique in the pipeline's table
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(prose(79, 59).split(" ")[5:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema if name != "sharding" else f"{SCHEMA}, shard int")
        kept[name] = docs.collect()
    lettered = [r for r in rows if re.search("[a-z]", r[1] or "")]
    assert Counter(map(tuple, kept["language_id"])) == Counter(lettered)
    firsts = {i for i, (_, c) in components(lettered).items() if i == c}
    assert Counter(map(tuple, kept["near_dedup"])) == Counter(r for r in lettered if r[0] in firsts)
    windows = {tuple(item.split(" ")[k : k + 10]) for k in range(26)}
    leaked = {r["doc_id"] for r in kept["near_dedup"] if any(tuple(w[k : k + 10]) in windows for w in [r["text"].split(" ")] for k in range(len(w)))}
    assert leaked == {59} and {r["doc_id"] for r in kept["decontamination"]} == firsts - leaked
    clean = {r["doc_id"]: tuple(r) for r in kept["decontamination"]}
    taken = Counter(r["doc_id"] for r in kept["source_mix"])
    assert {tuple(r) for r in kept["source_mix"]} == {clean[i] for i in taken} and max(taken.values()) <= 3
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(kept["decontamination"], SCHEMA)).collect() if r["copies"]}
    assert taken == copies
    assert Counter(tuple(r)[:5] for r in kept["sharding"]) == Counter(map(tuple, kept["source_mix"]))
    order = sorted((r["doc_id"], r["shard"]) for r in kept["sharding"])
    assert [s for _, s in order] == sorted(s for _, s in order) and {s for _, s in order} <= set(range(24))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(taken)


def test_held_out_accuracy_on_the_given_tables(spark):
    """Language and quality of the documents of sf0.01 that were not learned from."""
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = language.identify_held_out(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(found) > 100 and sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found)
    scored = quality.quality_held_out(docs, labels).where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert good and bad and sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
