"""The training-data operators against plain brute-force versions, on the small tables and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from foldline.llm import bpe, chat, components, decontaminate, egojoin, htmltext, langid, queries, rollup, secrets, sharding, simhash, suffixes, tokencount

#: Rows that every operator on texts must bear: nulls, empty and blank texts, repeats, odd characters, a long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "same text here for all"), (5, "same text here for all"), (5, "same text here for all"), (None, "same text here for all"),
    (6, "one"), (7, "Ünïcödé \U0001f600 é ß\x00\x1c end"), (8, "word " * 30_000), (9, "-- ?? !!"), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """With a further column whose name clashes with names used inside."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.withColumn("f0", F.lit("x")).withColumn("leak", F.lit(1)).withColumn("cid", F.lit(2)).withColumn("secret_blob", F.lit(3))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def smallest_reachable(n, edges, ids):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    least = {}
    for k in range(n):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(n)]


# ---- components


def test_components_of_a_path_a_star_and_awkward_edges(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 8), (8, 7), (None, 3), (-4, 2000)]
    made = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(made[k] == 0 for k in range(61)) and all(made[k] == 1000 for k in range(1000, 1200)) and made[2000] == -4
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 SimHash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark, docs):
    made = queries.op1_simhash_neardup(spark, SMALL).collect()
    told = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in told]
    edges = [(a, b) for a, b in itertools.combinations(range(len(told)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    least = smallest_reachable(len(told), edges, [r["doc_id"] for r in told])
    want = sorted((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(told, prints, least, strict=True))
    assert sorted(map(tuple, made)) == want


def test_simhash_of_awkward_rows(spark, awkward):
    rows = [tuple(r) for r in simhash.near_duplicates(awkward).select("id", "component_id").collect()]
    assert len(rows) == len(AWKWARD)
    known = collections.Counter(rows)
    assert known[(5, 4)] == 2 and known[(4, 4)] == 1 and known[(None, 4)] == 1 and known[(1, 1)] == 1 and known[(2, 1)] == 1 and known[(None, 1)] == 1
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "leaves"), [(2, 40), (5, 9), (16, 3)])
def test_trees_lose_no_pair(radius, leaves):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    f = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(12)]]))
    tree = simhash.build_tree(f, leaves, radius)
    home = tree.home(f)
    row, leaf = tree.visits(f, radius)
    seen = set(zip(row.tolist(), leaf.tolist(), strict=True))
    close = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    assert tree.leaves > 1 and all((a, home[b]) in seen for a, b in close.tolist())
    label = simhash.forest_within(f[:, None], f[:, None], radius, radius)
    whole = components.merge_labels(np.arange(len(f)), close[:, 0], close[:, 1])
    assert len(set(zip(label[len(f) :].tolist(), whole.tolist(), strict=True))) == len(set(whole.tolist()))


def test_a_tiled_leaf_gives_the_same_links(spark):
    rng = np.random.default_rng(3)
    f = np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64)[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    df = spark.createDataFrame([(k, int(np.int64(x))) for k, x in enumerate(f.view(np.int64))], "cid long, f0 long")
    sizes = [components.connected_components(simhash.links(df, 1, 2, 2, tile=tile)).groupBy("root").count().select("count").collect() for tile in (1 << 18, 50)]
    assert sorted(map(tuple, sizes[0])) == sorted(map(tuple, sizes[1]))


# ---- 2 token totals


def test_rollup_of_rules_equals_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    told = duck.execute(queries.ORACLES["rollup_of_rules"]).fetchall()
    made = queries.rollup_of_rules(spark, SMALL).select("source", "lang", "tokenizer_version", "documents", "tokens").collect()
    assert sorted(map(tuple, made)) == sorted(told)


def plain_encodings():
    import public_tokenizers

    return {v: tokencount.counter(tokencount.rank_table(queries.tokenizer_path(f"{v}.tiktoken")), public_tokenizers.PATTERN) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def test_rollup_query_equals_the_library(spark, docs):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    want = collections.Counter()
    for r in docs.collect():
        if r["doc_id"] not in toxic:
            for version, encoding in plain_encodings().items():
                key = r["source"], r["lang"], version
                want[key, 0] += 1
                want[key, 1] += len(encoding.encode_ordinary((r["text"] or "").replace("All rights reserved.", "")))
    made = queries.op2_token_rollup(spark, SMALL).select("source", "lang", "tokenizer_version", "documents", "tokens").collect()
    assert {(tuple(r)[:3], k): tuple(r)[3 + k] for r in made for k in (0, 1)} == dict(want)


def test_token_counts_of_awkward_rows(spark, awkward):
    import public_tokenizers

    files = {v: queries.tokenizer_path(f"{v}.tiktoken") for v in plain_encodings()}
    made = tokencount.token_counts(awkward, files, public_tokenizers.PATTERN)
    assert made.columns == ["doc_id", "f0", "leak", "cid", "secret_blob", "tokenizer_version", "n_tokens"]
    want = collections.Counter((i, v, len(e.encode_ordinary(t or ""))) for i, t in AWKWARD for v, e in plain_encodings().items())
    assert collections.Counter((r["doc_id"], r["tokenizer_version"], r["n_tokens"]) for r in made.collect()) == want
    assert tokencount.token_counts(awkward.limit(0), files, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        tokencount.token_counts(awkward.withColumn("N_TOKENS", F.lit(1)), files, public_tokenizers.PATTERN)


def test_rollup_batches_are_idempotent_and_signed(spark, tmp_path):
    totals = rollup.TokenRollup(spark, f"file://{tmp_path}/r")

    def batch(*rows):
        return spark.createDataFrame(list(rows), rollup.CHANGE)

    def now():
        return {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()}

    assert now() == {}
    assert totals.commit("b1", batch(("insert", 1, "v", "s", "en", 5), ("insert", 2, "v", "s", "en", 7), ("insert", 2, "v", "s", "en", 7), ("insert", None, "v", None, None, None)))
    assert now() == {("s", "en", "v"): (2, 12), (None, None, "v"): (1, 0)}
    assert not totals.commit("b1", batch(("insert", 9, "v", "s", "en", 100)))
    assert totals.commit("b2", batch(("revise", 1, "v", "t", "en", 6), ("delete", 2, "v", None, None, None), ("delete", 77, "v", "s", "en", 1), ("delete", None, "v", None, None, None)))
    assert now() == {("t", "en", "v"): (1, 6)}
    assert totals.commit("b3", batch()) and now() == {("t", "en", "v"): (1, 6)} and totals.batches() == ["b1", "b2", "b3"]
    with pytest.raises(Exception, match="unknown op"):
        totals.commit("b4", batch(("drop", 1, "v", "s", "en", 1)))
    assert totals.batches() == ["b1", "b2", "b3"]


def test_rollup_takes_the_last_change_and_reads_touched_buckets(spark, tmp_path):
    totals = rollup.TokenRollup(spark, f"file://{tmp_path}/s", buckets=8)
    kind = rollup.CHANGE + ", seq long"

    def batch(*rows):
        return spark.createDataFrame(list(rows), kind)

    def now():
        return {tuple(r)[:3]: tuple(r)[3:] for r in totals.totals().collect()}

    assert totals.commit("a", batch(("delete", 1, "v", "s", "en", 0, 2), ("insert", 1, "v", "s", "en", 5, 1), ("insert", 2, "v", "s", "en", 3, None), ("delete", 3, "v", "s", "en", 0, 1), ("insert", 3, "v", "s", "en", 4, 2)))
    assert now() == {("s", "en", "v"): (2, 7)}
    rng, held = random.Random(3), {2: ("s", 3), 3: ("s", 4)}
    for k in range(6):
        rows = []
        for seq in range(30):
            op, doc, source, n = rng.choice(["insert", "revise", "delete"]), rng.randrange(25), rng.choice("st"), rng.randrange(9)
            rows.append((op, doc, "v", source, "en", n, seq))
            held.pop(doc, None)
            if op != "delete":
                held[doc] = (source, n)
        assert totals.commit(f"r{k}", batch(*rows))
        if k == 3:
            before = now()
            totals.compact()
            assert now() == before and totals.batches()[-1] == "r3"
        want = collections.defaultdict(lambda: [0, 0])
        for source, n in held.values():
            want[source, "en", "v"][0] += 1
            want[source, "en", "v"][1] += n
        assert now() == {key: tuple(v) for key, v in want.items()}
    alive = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in totals.ledger().where("n_tokens IS NOT NULL").collect()}
    assert alive == held


def test_only_one_driver_claims_a_batch_number(spark, tmp_path):
    totals, rows = rollup.TokenRollup(spark, f"file://{tmp_path}/c"), spark.createDataFrame([("insert", 1, "v", "s", "en", 5)], rollup.CHANGE)
    (tmp_path / "c" / "claims").mkdir(parents=True)
    (tmp_path / "c" / "claims" / "000000000").touch()
    with pytest.raises(RuntimeError, match="claimed"):
        totals.commit("a", rows)
    assert totals.batches() == [] and totals.recover() and not totals.recover()
    assert totals.commit("a", rows) and totals.totals().count() == 1


# ---- 3 language identification


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    made = {r["doc_id"]: r for r in queries.op3_zstd_language(spark, sf).collect()}
    told = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(made) == len(told)
    apart = [r for r in told if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(made[r["doc_id"]]["held_out"] == (r in apart) for r in told)
    assert sum(made[r["doc_id"]]["lang_pred"] == r["lang"] for r in apart) / len(apart) > 0.97
    assert all(0 <= r["score"] <= 1 for r in made.values())


def plain_model(rows, most):
    """The texts of each language with the smallest hashes, whole."""
    by, n = collections.defaultdict(set), collections.Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            by[lang].add(text)
            n[lang] += 1
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    order = sorted(by, key=lambda x: (-n[x], x))
    return order, [" ".join(langid.prepared(t) for t in sorted(by[x], key=lambda t: (signed(t), t))[:most]).encode() for x in order]


def plain_prediction(text, model):
    import zstandard

    clean = langid.prepared(text or "")
    if not clean:
        return "und", 0.0
    sizes = []
    for content in model[1]:
        total = 0
        for level in (3, 6):
            bits = (len(content) + 4096).bit_length()
            base = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content))
            names = ("search_log", "min_match", "target_length", "strategy")
            own = {k: max(getattr(base, k), bits) for k in ("window_log", "hash_log", "chain_log")} | {k: getattr(base, k) for k in names}
            params = zstandard.ZstdCompressionParameters(**own, write_checksum=0, write_content_size=0, write_dict_id=0)
            told = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            for k in range(0, len(clean), 1024):
                total += len(zstandard.ZstdCompressor(dict_data=told, compression_params=params).compress(f" {clean[k : k + 1024]} ".encode()))
        sizes.append(total)
    best, second = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))[:2]
    return model[0][best], (sizes[second] - sizes[best]) / sizes[second]


def test_language_query_equals_a_plain_classifier(spark, docs):
    told = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    model = plain_model([v for i, v in told.items() if zlib.crc32(str(i).encode()) % 5], langid.SAMPLE_ROWS)
    made = queries.op3_zstd_language(spark, SMALL).collect()
    assert len(made) == len(told)
    for r in made:
        assert (r["lang_pred"], r["score"]) == plain_prediction(told[r["doc_id"]][0], model)


def test_copies_take_no_part_of_the_sample(spark):
    rare = [f"kleine seltene sprache nummer {chr(97 + k)} mit worten" for k in range(20)]
    rows = [("xx", t) for t in rare] + [("xx", "immer dieselbe zeile")] * 4000 + [("yy", "un seul texte")] * 3000
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), sample_rows=40)
    assert model.languages == ["xx", "yy"] and model.contents[1] == b"un seul texte"
    assert all(langid.prepared(t).encode() in model.contents[0] for t in rare)


def test_no_language_is_lost_to_copies(spark):
    rows = [("fr", "la maison est sur la colline")] * 20_000 + [("en", f"the house number {'abcdefghij'[k % 10]}{k // 10 * 'x'} is on the hill") for k in range(500)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["fr", "en"]
    known = langid.Classifier(model)
    assert known.classify("la maison")[0] == "fr" and known.classify("the house")[0] == "en"


def test_samples_are_whole_texts_of_the_number_asked_for(spark):
    texts = [f"anfang {chr(97 + k % 26)}{k // 26 * 'q'} " + "mitte " * 2000 + f"ende{chr(97 + k % 26)}{k // 26 * 'q'}" for k in range(60)]
    model = langid.fit(spark.createDataFrame([("xx", t) for t in texts], "lang string, text string"), sample_rows=9)
    assert sum(langid.prepared(t).encode() in model.contents[0] for t in texts) == 9
    assert model.contents == plain_model([(t, "xx") for t in texts], 9)[1]


def test_one_rule_for_texts_of_all_lengths(spark, docs):
    """A letter more, beyond what was once a limit, changes a score by little."""
    known = langid.Classifier(langid.fit(docs))
    text = langid.prepared(" ".join(r["text"] for r in docs.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").limit(5).collect()))
    for n in (600, 1023, 1024, 2048):
        (a, x), (b, y) = known.classify(text[:n]), known.classify(text[: n + 1])
        assert a == b and abs(x - y) < 0.05


def test_all_of_a_long_dictionary_is_used():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(100_000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    first = say(150)
    long = (first + " " + say(400_000)).encode()
    for level in langid.LEVELS:
        assert len(langid._compressor(long, level).compress(first[:1000].encode())) < 100


def test_language_of_awkward_rows(spark, docs, awkward):
    model = langid.fit(docs)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and "f0" in rows[0].asDict()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert langid.identify(awkward.limit(0), model).count() == 0
    none = langid.identify(awkward, langid.fit(docs.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    with pytest.raises(ValueError, match="lang_pred"):
        langid.identify(awkward.withColumn("lang_pred", F.lit("")), model)


# ---- 4 decontamination


def plain_leaks(text, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated, longest, its place, item and place there)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, found, best = set(), set(), None
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(body))
        n = min(8, len(own))
        for j in range(len(own) - n + 1 if own else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[j : j + n]:
                    hit.update(range(k, k + n))
                    found.add(item)
                    more = n
                    while n == 8 and k + more < len(words) and j + more < len(own) and words[k + more] == own[j + more]:
                        more += 1
                    key = -more, k, item is None, str(item), j
                    best = min(best or key, key)
    names = sorted(str(i) for i in found if i is not None)
    place = (0, None, None, None) if best is None else (-best[0], best[1], None if best[2] else best[3], best[4])
    return len(words), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), len(found) >= 2, *place


def told_leaks(leak):
    """The same of the struct of `hits`."""
    n_hit = sum(s["end"] - s["start"] for s in leak["spans"])
    names = hashlib.sha256(",".join(leak["items"]).encode()).hexdigest()
    place = leak["longest"], leak["longest_start"], leak["longest_item"], leak["longest_item_start"]
    return leak["n_words"], n_hit, leak["n_items"], names, leak["n_items"] >= 2, *place


def test_decontamination_query_equals_brute_force(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    for r in queries.op4_suffix_decontamination(spark, SMALL).collect():
        text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"] if r["n_hit"] else None
        if text is not None:
            assert tuple(r)[1:6] == plain_leaks(text, items)[:5]
    texts = docs.select("doc_id", "text").collect()
    grams = {g for _, t in items for g in zip(*[re.findall(r"[0-9a-z\x80-\U0010ffff]+", ascii_lower(t))[k:] for k in range(8)], strict=False)}
    leaking = {r["doc_id"] for r in texts if grams & set(zip(*[re.findall(r"[0-9a-z\x80-\U0010ffff]+", ascii_lower(r["text"]))[k:] for k in range(8)], strict=False))}
    assert leaking == {r["doc_id"] for r in queries.op4_suffix_decontamination(spark, SMALL).collect() if r["n_items"]}


def test_decontamination_query_equals_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    told = duck.execute(queries.ORACLES["op4_suffix_decontamination"])
    names = [d[0] for d in told.description]
    made = queries.op4_suffix_decontamination(spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, made), key=str) == sorted(told.fetchall(), key=str)


def test_decontamination_of_random_words_short_items_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("a b C dé 7".split()) for _ in range(n))
    rows = [(k, say(rng.randrange(60))) for k in range(40)] + [(40, None), (41, ""), (None, say(9)), (42, "a b")]
    items = [(k, say(rng.choice([1, 2, 5, 8, 9, 14]))) for k in range(9)] + [(9, None), (10, "--"), (None, "a"), (3, say(8)), (None, say(11))]
    rows += [(50 + k, "x " + items[k][1] + " " + say(3)) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leak", F.lit(1)).withColumn("row", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = [(i, t) for i, t in items if t is not None]
    for size, shard in ((1 << 20, 1 << 20), (1 << 20, 50), (20, 50)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        made = decontaminate.hits(df, bench, block_bytes=size, column="found").collect()
        assert len(made) == len(rows)
        for r in made:
            assert told_leaks(r["found"]) == plain_leaks(r["text"], kept)
            ends = [s["end"] for s in r["found"]["spans"]]
            assert all(a < s["start"] for a, s in zip(ends, r["found"]["spans"][1:], strict=False))
    assert decontaminate.hits(df, bench, column="found", keep_text=False).columns == ["doc_id", "leak", "row", "found"]
    with pytest.raises(ValueError, match="leak"):
        decontaminate.hits(df, bench)
    clashing = df.withColumn("foldline_leak", F.lit(3))
    clean = decontaminate.decontaminate(clashing, bench.limit(0), least_items=1)
    assert clean.count() == len(rows) and clean.columns == clashing.columns
    gone = {r["doc_id"] for r in rows_of(rows) if plain_leaks(r["text"], kept)[2] >= 3}
    left = [r["doc_id"] for r in decontaminate.decontaminate(clashing, bench, least_items=3).collect()]
    assert len(left) == sum(r["doc_id"] not in gone for r in rows_of(rows))
    assert decontaminate.hits(df.limit(0), bench, column="found").count() == 0


def rows_of(rows):
    return [{"doc_id": i, "text": t} for i, t in rows]


def test_items_without_an_id_hit(spark):
    df = spark.createDataFrame([(1, "x one two three four five six seven eight y")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three four five six seven eight")], "item_id long, text string")
    r = decontaminate.hits(df, bench).first()["leak"]
    assert (r["n_items"], r["items"], [(s["start"], s["end"]) for s in r["spans"]], r["longest"], r["longest_item"]) == (1, [], [(1, 9)], 8, None)


def test_suffixes_are_in_whole_order():
    rng = np.random.default_rng(2)
    for _ in range(60):
        words = rng.integers(0, rng.integers(2, 5), rng.integers(0, 80))
        words = np.concatenate([words, words[: len(words) // 2]])
        highest = int(rng.choice([3, 3000, 2**40]))
        least = int(rng.integers(1, 4))
        made = suffixes.SuffixArray(words, least, highest).order.tolist()
        run = suffixes.runs(words)
        own = sorted((tuple(words[k : k + run[k]].tolist()), k) for k in range(len(words)) if run[k] >= least)
        assert [tuple(words[k : k + run[k]].tolist()) for k in made] == [w for w, _ in own] and sorted(made) == sorted(k for _, k in own)


def test_a_passage_of_many_copies_is_sorted_in_few_rounds():
    words = np.tile(np.append(np.arange(1, 2000), 0), 200)
    began = time.perf_counter()
    order = suffixes.SuffixArray(words, 8, 2000).order
    assert len(order) == 200 * (1999 - 7) and time.perf_counter() - began < 5


def test_longest_matches_are_maximal():
    tests = decontaminate.compile_tests([("x", "a b c d e f g h i j"), ("y", "q r s")])
    texts = ["z b c d e f g h i j z", "q r s q r s", None, "a b c d e f g"]
    found = decontaminate.longest_matches(texts, tests)
    got = {tuple(r) for r in found.itertuples(index=False)}
    assert got == {(0, "x", 1, 1, 9), (1, "y", 0, 0, 3), (1, "y", 0, 3, 3)}
    assert [d["longest"] for d in decontaminate._leaks([decontaminate.numbered(t, tests) for t in texts[:3]], tests)] == [9, 3, 0]


# ---- 5 chat


def test_chat_query_reads_back_every_turn(spark):
    made = {r["conv_id"]: r for r in queries.op5_budgeted_chat(spark, SMALL).collect()}
    told = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        told[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    told[-7] = [(k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    assert set(made) == set(told)
    for conv, turns in told.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        r = made[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "<", "[", "|", ">", "s", "/", "x", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        made = chat.escaped(text)
        assert chat.unescaped(made) == text and not any(c in made for c in chat.CONTROL)
        assert chat.parsed(chat.rendered(text, text)[0]) == [(text, text)]


def test_windows_keep_to_the_budget_and_learn_once():
    rng = random.Random(2)
    for _ in range(60):
        turns = [("system", "rules")] * rng.randrange(2) + [(rng.choice(["user", "assistant", "tool"]), "x" * rng.randrange(60)) for _ in range(rng.randrange(1, 40))]
        made = list(chat.windows(iter(turns), len, budget=300, history=100))
        back = [t for w in made for t in chat.parsed(w["formatted"])[w["n_repeated"] :]]
        assert back == turns
        assert "".join(chat.unescaped(w["formatted"][a:b]) for w in made for a, b in w["loss"]) == "".join(t for r, t in turns if r == "assistant")
        assert all(w["n_tokens"] <= 300 or w["n_new"] == 1 for w in made) and all(w["n_tokens"] == len(w["formatted"]) for w in made)
        if turns[0][0] == "system":
            assert all(chat.parsed(w["formatted"])[0] == turns[0] for w in made)


def test_chat_of_awkward_rows(spark):
    import public_tokenizers

    rows = [(1, 0, None, None), (1, None, "user", "first"), (None, 0, "user", "n"), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    made = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df, path, public_tokenizers.PATTERN)).collect()}
    assert {k: r["n_turns"] for k, r in made.items()} == {1: 2, None: 1, 2: 3}
    assert made[1]["turns_sha256"] == hashlib.sha256(b"user\nfirst\n\n\n").hexdigest()
    assert chat.read_back(chat.format_windows(df.limit(0), path, public_tokenizers.PATTERN)).count() == 0


# ---- 6 sharding


def test_sharding_query(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    made = queries.op6_rendezvous_shards(spark, SMALL).collect()
    assert len(made) == len(texts)
    for r in made:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in made if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_by_weight_and_of_awkward_rows(spark, awkward):
    rows = sharding.assign_shards(awkward, {0: 1.0, 1: 1.0}).collect()
    assert len(rows) == len(AWKWARD) and sorted(r["slot"] for r in rows if r["shard"] == rows[0]["shard"])[0] == 0
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["key"] in (1, 2))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    share = sharding.assign_shards(many, {0: 1.0, 1: 3.0}).where("shard = 1").count() / 20_000
    assert abs(share - 0.75) < 0.02
    assert sharding.assign_shards(awkward.limit(0), {0: 1.0}).count() == 0
    for wrong in ({}, {0: 0.0}, {0: 1.0, 1: -1.0}, {0: float("nan")}, {0: float("inf")}):
        with pytest.raises(ValueError, match="weights"):
            sharding.assign_shards(awkward, wrong)
        with pytest.raises(ValueError, match="weights"):
            sharding.assign_shards(awkward, {0: 1.0}, wrong)


def test_hot_keys_and_long_runs_are_numbered_alike(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(7, f"text {rng.randrange(150)}") for _ in range(400)] + [(7, "again")] * 300 + [(8, "x")] * 50 + [(k, f"t{k}") for k in range(300)] + [(None, "n")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    for hot, run in ((100_000, 1 << 20), (20, 1 << 20), (20, 16), (100_000, 16)):
        monkeypatch.setattr(sharding, "HOT_KEY", hot)
        monkeypatch.setattr(sharding, "LONG_RUN", run)
        made.append(sorted(map(tuple, sharding.assign_shards(df, {0: 1.0, 1: 1.0, 2: 2.0}, {s: 1.0 for s in range(4)}).collect()), key=str))
    assert made[0] == made[1] == made[2] == made[3] and len(made[0]) == len(rows)
    for s in range(3):
        slots = sorted(r[5] for r in made[0] if r[4] == s)
        assert slots == list(range(len(slots)))
    of = sorted((r[5], r[2], r[1]) for r in made[0] if r[0] == 7)
    assert len(of) == 701 and of[-1][0] - of[0][0] == 700 and [x[1:] for x in of] == sorted(x[1:] for x in of)


# ---- 7 BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_bpe_query_equals_the_library(spark, docs, tokenizer):
    made = {r["doc_id"]: r for r in queries.op7_chunk_bpe(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(made) == len(rows)
    for r in rows:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        told = tokenizer.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()
        assert tuple(made[r["doc_id"]])[1:] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_of_odd_texts(name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    plain, own = Tokenizer.from_file(path), bpe.ChunkEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(1)
    bits = [*"ab  \n\t\x1c\x85\xa0́é'sİIßΣς1٣각\U0001f600\x00-_", "<|endoftext|>", "'ll", " ́", "  ", "word "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(300))) for _ in range(400)] + ["", " ", "x" * 5000, "ab " * 9000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == want
        assert own.decode(ids) == plain.decode(want, skip_special_tokens=False)


def test_bpe_of_awkward_rows(spark, awkward):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = bpe.encode_decode(awkward, path, keep_text=True).collect()
    assert len(rows) == len(AWKWARD) and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == [] and r["decoded"] == "" for r in rows if not (r["text"] or "").strip())
    assert bpe.encode_decode(awkward.limit(0), path).count() == 0
    assert bpe.encode_decode(awkward, path, decode=False).columns == ["doc_id", "f0", "leak", "cid", "secret_blob", "n_tokens", "ids"]
    with pytest.raises(ValueError, match="ids"):
        bpe.encode_decode(awkward.withColumn("IDS", F.lit(1)), path)


def test_joins_that_do_not_agree_are_repaired():
    """White space and no-break spaces by turns: tokens of this tokenizer hold both, and a chunk may end between them."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), bpe.ChunkEncoder(open(path, encoding="utf-8").read())
    texts = ["".join(f"word{k} \xa0 \xa0  \xa0" for k in range(n, n + 300)) for n in range(20)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not all(own.joins.values())


def test_pieces_go_to_the_tokenizer_many_at_once():
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, inner):
            self.inner, self.given = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.given += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    path = queries.tokenizer_path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), bpe.ChunkEncoder(open(path, encoding="utf-8").read())
    own.tokenizer = Counted(own.tokenizer)
    texts = [" ".join(f"Wort{n * k} läuft'{k}," for k in range(400)) for n in range(1, 6)]
    odd = ["a <|endoftext|> b", "<|endoftext|", "<|endoftext|><|endoftext|>", "x<|start", "oftext|> <|startoftext|>y", "<|end oftext|>", "", "\xa0", "\xa0 \xa0"]
    for some, most in ((texts, 100), (odd, 1000)):  # one string a piece would be over 2,000
        own.tokenizer.given = 0
        for text, ids in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert own.tokenizer.given < most


def test_caches_are_bounded_and_forget(monkeypatch):
    from tokenizers import Tokenizer

    for name in ("CHUNK_BYTES", "PIECE_BYTES", "JOIN_BYTES"):
        monkeypatch.setattr(bpe, name, 20_000)
    path = queries.tokenizer_path("word_bpe_49k.json")
    plain, own, rng = Tokenizer.from_file(path), bpe.ChunkEncoder(open(path, encoding="utf-8").read()), random.Random(6)
    for _ in range(40):
        texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(3)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert max(map(len, (own.chunks, own.pieces, own.joins, own.chunks.old, own.pieces.old, own.joins.old))) < 1500


def test_only_known_definitions_are_taken_apart():
    import json

    spec = json.load(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8"))
    assert bpe.spans_no_space(spec)
    for part, value in (("normalizer", {"type": "Prepend", "prepend": " "}), ("pre_tokenizer", None), ("pre_tokenizer", {"type": "Metaspace"})):
        assert not bpe.spans_no_space(spec | {part: value})
    assert not bpe.spans_no_space(spec | {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False, "single_word": False}]})


# ---- 8 secrets

PLAIN_RULES = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 6, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 24, 0),
)


def plain_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, least, group) in enumerate(PLAIN_RULES) for m in p.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_secret_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"  # the smallest has no secret
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    made = queries.op8_secret_ledger(spark, sf).collect()
    assert len(made) == len(texts) and any(r["spans"] for r in made)
    for r in made:
        want = plain_spans(texts[r["doc_id"]])
        assert (r["spans"], r["base_sha256"]) == (want, hashlib.sha256(want.encode()).hexdigest())
        assert r["n_hex"] == want.count("hex:") and r["n_assign"] == want.count("assign:")


def test_secrets_of_odd_texts_and_incremental_scans(spark, tmp_path):
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", "'", '"', "abc123", "x", "AKIA", "A1B2C3D4E5F6G7H8", "0af9" * 6, "é", "\U0001f600", "", "", "\n", "\\", "$1", "ſ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)] + [None, "", "secret=token = \"abcdefgh\"", "token=abcdef " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string").withColumn("blob", F.lit("clash"))
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    ledger.scan(df.where("path < 100"))
    first = ledger.entries().count()
    ledger.scan(df)
    entries = ledger.entries().count()
    ledger.scan(df)
    assert first < entries == ledger.entries().count() == len({t or "" for t in texts})
    assert secrets.BlobLedger(spark, f"file://{tmp_path}/ledger", "other").entries().count() == 0
    made = ledger.findings_of(df).select("*", secrets.spans_string(F.col("secret_spans")).alias("s"), secrets.redact(F.col("text"), F.col("secret_spans")).alias("redacted")).collect()
    assert len(made) == len(texts)
    for r in made:
        assert r["s"] == plain_spans(r["text"])
        if not r["s"]:
            assert r["redacted"] == r["text"]
            continue
        merged = []
        for _, a, b in (x.split(":") for x in r["s"].split(",")):
            if merged and int(a) < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], int(b))
            else:
                merged.append([int(a), int(b)])
        out, at = "", 0
        for a, b in merged:
            out, at = out + r["text"][at:a] + "[SECRET]", b
        assert r["redacted"] == out + r["text"][at:]
    ledger.scan(df.limit(0))
    assert ledger.findings_of(df.limit(0)).count() == 0


def test_rules_belong_to_their_version(spark, tmp_path):
    df = spark.createDataFrame([(1, "key pk-1234567 and password=abcdef1"), (2, None)], "path int, text string").withColumn("secret_blob", F.lit("mine")).withColumn("blob", F.lit(1))
    path = f"file://{tmp_path}/ledger"
    own = (("pk", "", "pk-[0-9]+", 8),)
    base, other, changed = secrets.BlobLedger(spark, path), secrets.BlobLedger(spark, path, "pk-1", own), secrets.BlobLedger(spark, path, "pk-1", (("pk", "", "pk-[0-9]+", 11),))
    for ledger in (base, other):
        ledger.scan(df)
    seen = lambda ledger: {r["path"]: [s["kind"] for s in r["secret_spans"]] for r in ledger.findings_of(df).collect()}
    assert seen(base) == {1: ["assign"], 2: []} and seen(other) == {1: ["pk"], 2: []}
    assert changed.entries().count() == 0 and other.entries().count() == 2
    assert base.findings_of(df).columns == ["path", "text", "secret_blob", "blob", "secret_spans"]
    assert {r["secret_blob"] for r in base.findings_of(df).collect()} == {"mine"}
    with pytest.raises(ValueError, match="secret_spans"):
        base.findings_of(df.withColumn("SECRET_SPANS", F.lit(1)))
    with pytest.raises(ValueError, match="kinds"):
        secrets.BlobLedger(spark, path, "x", own * 2)


def test_scans_of_many_and_of_few_new_blobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(secrets, "FEW", 5)
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    rows = [(f"password = number{k}",) for k in range(40)] * 2
    for n in (3, 6, 40, 40, 80):
        ledger.scan(spark.createDataFrame(rows[:n], "text string"))
        assert ledger.entries().count() == ledger.entries().select("blob").distinct().count() == min(n, 40)


# ---- 9 embeddings


def plain_links(vectors, limit=0.9):
    usable = [k for k, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    edges = []
    for a, b in itertools.combinations(usable, 2):
        x, y = np.array(vectors[a], float), np.array(vectors[b], float)
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= limit:
            edges.append((a, b))
    return edges


def test_embedding_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r["vec_id"] for r in rows], [r["embedding"] for r in rows]
    edges = plain_links(vectors)
    degree = collections.Counter(itertools.chain(*edges))
    least = smallest_reachable(len(ids), edges, ids)
    want = sorted((i, degree[k], c, i == c) for k, (i, c) in enumerate(zip(ids, least, strict=True)))
    assert sorted(map(tuple, queries.op9_ego_neardup(spark, SMALL).collect())) == want


def test_embeddings_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.1], [0.0, 1.0], [0.0, 0.0], None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [-1.0, 0.0]]
    rows = list(zip([5, 5, 3, 7, 8, 9, 10, 11, 12, 13, 14, None], vectors, strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    made = sorted(map(tuple, egojoin.near_duplicates(df).collect()), key=str)
    want = [(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 0, None, True)] + [(k, 0, k, True) for k in (7, 8, 9, 10, 11, 12, 13, 14)]
    assert made == sorted(want, key=str)
    assert egojoin.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_every_length_link(spark):
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0], [3.0], [-1.0], [1.0] * 20, [0.0, 0.0, 1.0]]
    made = egojoin.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    want = {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in made} == want


def test_embeddings_of_every_magnitude_link(spark):
    vectors = [[1e-200, 1e-200], [0.8, 0.1], [1e200, 1e200], [2e200, 2e200], [5e-324, 0.0], [1.7e308, 1e-300], [1e-310, 1e-310], [-1e200, -1e200], [8e-9, 1e-9]]
    made = egojoin.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    scaled = [[float(np.ldexp(c, -int(np.frexp(max(map(abs, v)))[1]))) for c in v] for v in vectors]
    edges = plain_links(scaled)
    degree, least = collections.Counter(itertools.chain(*edges)), smallest_reachable(len(vectors), edges, list(range(len(vectors))))
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in made} == {k: (degree[k], least[k]) for k in range(len(vectors))}
    assert (0, 2) in edges and (2, 3) in edges and (1, 4) in edges and (0, 1) not in edges


@pytest.mark.parametrize(("interval", "tile"), [(10_000, 50), (120, 40), (120, 500)])
def test_tiles_of_large_intervals_lose_no_link(spark, monkeypatch, interval, tile):
    monkeypatch.setattr(egojoin, "INTERVAL", interval)
    monkeypatch.setattr(egojoin, "TILE", tile)
    monkeypatch.setattr(egojoin, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(scale=0.3, size=(70, 6)) for c in rng.normal(size=(6, 6))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, 0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = {r["id"]: (r["n_links"], r["component_id"]) for r in egojoin.near_duplicates(df).collect()}
    least = smallest_reachable(len(x), np.argwhere(cos >= 0.9).tolist(), list(range(len(x))))
    assert [made[k] for k in range(len(x))] == list(zip((cos >= 0.9).sum(1).tolist(), least, strict=True))


def test_grid_order_join_of_clusters_over_many_intervals(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "INTERVAL", 40)
    monkeypatch.setattr(egojoin, "BLOCK", 16)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(scale=0.25, size=(60, 8)) for c in centres])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, 0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = {r["id"]: r["n_links"] for r in egojoin.near_duplicates(df).collect()}
    assert [made[k] for k in range(len(x))] == (cos >= 0.9).sum(1).tolist()


# ---- 10 HTML


def test_pages_give_their_articles(spark):
    import html

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        assert htmltext.main_text(r["html"], htmltext.trained()) == "\n".join(p for p in parts if p)
    made = queries.op10_flat_blocks(spark, SMALL)
    assert made.columns == ["page_id", "url", "text", "n_chars"] and made.where("n_chars <> char_length(text)").count() == 0


PAGE = """<!doctype html><html><head><title>No</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="page">
<header><a href="/">Home</a> <a href="/x">News</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies. <button>Accept</button></div>
<main><article><header><h1>Fish &amp; chips&nbsp;today</h1></header><p>First   paragraph with <a href="/l">a link</a>, some
words and <b>bold</b> ones.<p>Unclosed second<br>line &lt;ok&gt;</p><ul><li>point one</li><li>point two</li></ul>
<aside class="related"><a href="/r">Read also</a></aside><form><label>Mail</label><input name=q></form><!-- <p>no</p> -->
<table><tr><td>cell 1</td><td>cell 2</td></tr></table><p>Last.</p></article></main>
<section id="comments"><article><p>A reader says something rather long about fish and chips here.</p></article></section>
<div class="sidebar"><p>Side text that goes on for quite a while to look like text.</p></div><footer>&copy; 2024 Someone</footer></body></html>"""


def test_a_page_with_everything():
    want = ["Fish & chips today", "First paragraph with a link, some words and bold ones.", "Unclosed second line <ok>", "point one", "point two", "cell 1", "cell 2", "Last."]
    assert htmltext.main_text(PAGE, htmltext.trained()).split("\n") == want


def test_pages_without_a_main_element_and_awkward_rows(spark):
    tree = htmltext.trained()
    long = "This is a paragraph with a good many words in it, so that it looks like the main text of the page. " * 2
    page = f"<body><div><a href=1>One</a></div><div><a href=2>Two</a></div><div>{long}</div><div>{long}</div><div><a href=3>Three</a></div></body>"
    assert htmltext.main_text(page, tree).split("\n") == [long.strip()] * 2
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p"), (5, "<script>x"), (6, "<!-- x"), (7, "plain"), (8, "<div " * 3000), (9, "<article><p>cut o"), (9, "<article><p>cut o")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("made", F.lit("clash"))
    made = htmltext.extract(df).collect()
    assert len(made) == len(rows) and [r["text"] for r in made if r["page_id"] == 9] == ["cut o"] * 2 and all(r["text"] is not None for r in made)
    assert htmltext.extract(df.limit(0)).count() == 0


LAYOUT = "<html>{body}<nav><a href=/>Home</a></nav>{article}<p>" + "A long sentence of the article stands here for the reader. " * 5 + "</p></article><footer><p>Imprint</p></footer></body></html>"


@pytest.mark.parametrize("body", ["<body>", '<body class="single has-sidebar">', "<body id=search data-hidden=\"false\">", '<body data-note="is hidden here">'])
@pytest.mark.parametrize("article", ["<article>", '<article class="post no-comments">', '<article id="share" data-role="navigation">'])
def test_layout_words_of_whole_elements_are_no_noise(body, article):
    assert htmltext.main_text(LAYOUT.format(body=body, article=article), htmltext.trained()).startswith("A long sentence")


def test_hidden_and_noisy_containers_still_go():
    for tag in ('<div hidden>', '<div HIDDEN="">', '<div aria-hidden="true">', '<div class="sidebar">', '<div class="x footerWidgets">', "<div role='navigation'>", "<div style='display: none'>"):
        assert "gone" not in htmltext.main_text(LAYOUT.format(body="<body>", article=f"<article>{tag}<p>{'gone ' * 30}</p></div>"), htmltext.trained())


@pytest.mark.parametrize("name", ["social-history", "has-sidebar", "notice-board-records", "menu_of_the_day recipe", "no-comments", "searching"])
def test_names_that_hold_a_noisy_word_are_not_noise(name):
    page = f"<body><nav><a href=/>Home</a></nav><div class='{name}'><p>Rain fell all day.</p><p>{'The river rose. ' * 5}</p><p>Nobody was hurt.</p></div></body>"
    assert htmltext.main_text(page, htmltext.trained()).split("\n") == ["Rain fell all day.", ("The river rose. " * 5).strip(), "Nobody was hurt."]


def test_short_paragraphs_stay():
    page = "<body><p>Rain fell all day.</p><p>The river came up as far as the second step of the church by noon.</p><p>Nobody was hurt.</p></body>"
    assert len(htmltext.main_text(page, htmltext.trained()).split("\n")) == 3
    assert htmltext.main_text('<body><nav><a href="/">x</a></nav><article class="post promo-2024"><p>Hello there</p></article></body>', htmltext.trained()) == "Hello there"


def test_all_of_an_article_stays_and_neighbours_decide_elsewhere():
    tree, names = htmltext.trained(), htmltext.FEATURES
    used = set()

    def walk(node, kept):
        """Whether all leaves that a block of an article can reach keep it."""
        if node.feature < 0:
            return node.keep or not kept
        name = names[node.feature]
        used.add(name)
        fixed = {"main": True, "page_has_main": True, "named": False, "element": False}
        left, right = walk(node.left, kept and not fixed.get(name, False)), walk(node.right, kept and fixed.get(name, True))
        return left and right

    assert walk(tree, True)
    assert {"density", "words_after", "words_before", "density_after"} <= used


#: Pages that take no part in training, in the same notation as those that do.
HELD_OUT = (
    """
 <html><body><div id="masthead">
-<a href="/">The Ferry Post</a>
 </div><div class="nav-bar">
-<a href="/l">Local</a> <a href="/s">Sea</a>
 </div><div class="story">
+<h1>New ferry sails without a captain</h1>
+<p>The council's new ferry crossed the sound on Monday with forty passengers and nobody at the wheel, as its makers had promised.</p>
+<p>It arrived on time.</p>
+<p>A captain was on board in case he was needed, and he spent the crossing with the passengers, who had many questions about the birds.</p>
 </div><div class="ad-box">
-<p>Boats by the hour, with or without a skipper, from the yellow pier on every day but Sunday.</p>
 </div><div class="comments">
-<p>I was there and it was a bit dull to be honest, but the birds were lovely and so was the captain.</p>
 </div><footer>
-<p>The Ferry Post</p>
 </footer></body></html>
""",
    """
 <html><body>
-<div><a href="/">Recipes</a> <a href="/s">Search</a></div>
+<h2>Onion soup</h2>
+<p>Cut the onions as thin as you can and let them turn brown in butter, which takes most of an hour and can't be hurried.</p>
+<p>Salt.</p>
+<p>Add the stock and the bread, cover the bowls with cheese, and bake them until somebody in the house asks what smells so good.</p>
-<div><a href="/2">Leek soup</a></div>
-<div><a href="/3">Bean soup</a></div>
 </body></html>
""",
    """
 <html><body><main>
+<h1>Manuel</h1>
+<p>Branchez la lampe.</p>
 <ul>
+<li>Bouton rouge</li>
+<li><a href="/v">Bouton vert</a></li>
 </ul>
 <aside>
-<p>Les autres lampes de la maison sont montrées sur une page qui leur est propre, avec leurs prix.</p>
 </aside>
+<p>Attendez une minute avant de la toucher, car le verre devient très chaud quand elle vient d'être allumée pour la première fois.</p>
 </main><footer>
-<p>Fin de page</p>
 </footer></body></html>
""",
    """
 <html><body><ul>
-<li><a href="/">Anfang</a></li>
-<li><a href="/k">Karten</a></li>
 </ul>
+<div>Der Weg beginnt hinter der Schule und führt in einer Stunde zum alten Steinbruch, in dem heute ein See liegt.</div>
+<div>Baden ist verboten.</div>
+<div>Wer weiter will, geht links um den See herum und folgt dem Bach bis zur Mühle, die im Sommer Kuchen verkauft.</div>
-<div><a href="/v">Voriger Weg</a></div>
-<div><a href="/n">Nächster Weg</a></div>
 </body></html>
""",
)


def test_quality_on_pages_that_took_no_part_in_training():
    x, y = htmltext.table(HELD_OUT)
    right = sum(htmltext.trained().decide(tuple(r)) == bool(k) for r, k in zip(x, y, strict=True))
    assert right / len(y) >= 0.95
    right = n = 0
    for k, page in enumerate(htmltext.PAGES):
        tree = htmltext.trained(htmltext.PAGES[:k] + htmltext.PAGES[k + 1 :])
        x, y = htmltext.table((page,))
        right, n = right + sum(tree.decide(tuple(r)) == bool(v) for r, v in zip(x, y, strict=True)), n + len(y)
    assert right / n >= 0.9


def plain_article(page):
    """The article of a generated page, read by the standard library's parser."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts, self.blocks = 0, [], []

        def end_block(self):
            text = " ".join("".join(self.parts).split())
            self.blocks += [text] * bool(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag == "br":
                self.parts.append(" ")
            elif tag not in ("b", "i", "a", "em", "span"):
                self.end_block()

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a", "em", "span", "br"):
                self.end_block()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(reader.blocks)


def test_page_query_equals_a_plain_reader(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    made = queries.op10_flat_blocks(spark, sf).collect()
    assert len(made) == len(pages)
    for r in made:
        want = plain_article(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div>x", '<a =">" ', "<!-- ", "<script>", "<script></script ", "<button>", "<", "&", "</div>", "<b><div></b></div>", "<title/>"])
def test_time_grows_with_the_page(piece):
    def took(n):
        began = time.process_time()
        htmltext.main_text(piece * n + ">", htmltext.trained())
        return time.process_time() - began

    small, large = min(took(10_000) for _ in range(3)), min(took(40_000) for _ in range(2))
    assert large < 8 * small + 0.2


def test_containers_left_open_or_closed_twice():
    tree = htmltext.trained()
    page = "<body><div class=ad><p>Buy more of them today while they last.<article><p>The text begins here.</p></section></span><p>It goes on.</p></article></article></body>"
    assert htmltext.main_text(page, tree).split("\n") == ["The text begins here.", "It goes on."]
    assert htmltext.main_text("<article><button>Menu<p>First of all.</p><button>x</button><select><option>1</select><p>Last.</p></article>", tree).split("\n")[1:] == ["First of all.", "Last."]


# ---- pipeline


def test_pipeline_keeps_clean_rows_and_acts(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = source.where("length(text) > 400 AND lang = 'en'").orderBy("doc_id").limit(12)
    base = clean.first()["text"]
    words = base.split(" ")
    near = " ".join([*words[:20], "changed", *words[21:]])
    extra = [
        (900, base, "en", "s", len(base)), (901, near, "en", "s", len(near)), (902, "12 34 !!", "en", "s", 8), (903, None, None, None, None), (904, "", "en", "s", 0),
        (905, "The text of a leak. " + item, "en", "s", 99), (906, words[3] + " the thing that password = hunter2000 and so on of the", "en", "s", 60),
    ]
    rows = clean.unionByName(spark.createDataFrame(extra, source.schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert k == len(pipeline.STAGES) - 1 or docs.columns == source.columns
    first = clean.first()["doc_id"]
    assert {902, 903, 904} & set(seen["language_id"]) == set() and {900, 901, 905, 906} <= set(seen["language_id"])
    assert {900, 901} & set(seen["simhash_neardup"]) == set() and first in seen["simhash_neardup"]
    assert 905 not in seen["decontaminate"] and 906 in seen["decontaminate"]
    assert "hunter2000" not in seen["secrets"][906]["text"] and seen["secrets"][906]["n_chars"] == len(seen["secrets"][906]["text"])
    assert set(seen["bpe"]) == set(seen["secrets"]) and all(len(r["ids"]) == r["n_tokens"] for r in seen["bpe"].values())
    ran = pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in ran.collect()) == sorted(seen["bpe"])
