"""Decontamination, URL rules and cascade, personal data, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import decontaminate, hmm, packing, pii, simhash, toxicity, url_filter


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute_leaks(docs, items):
    """Aligned windows by exact weighted similarity."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    out = {}
    for d, text in docs:
        words = split(text)
        sh = shingles(words)
        for i, item in items:
            want = split(item)
            ish = shingles(want)
            places = {}
            for q, s in enumerate(ish):
                places.setdefault(s, []).append(q)
            starts = {max(0, min(p - q, len(words) - len(want))) for p, s in enumerate(sh) for q in places.get(s, ())}
            for s in starts:
                a, b = Counter(shingles(words[s : s + len(want)])), Counter(ish)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8:
                    out[d, i] = max(out.get((d, i), (0, 0)), (sim, -s))
    return {k: (-s, round(x, 9)) for k, (x, s) in out.items()}


def test_leaks_equal_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]].values.tolist()
    items = pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    rng = random.Random(2)
    for k, (_, text) in enumerate(items[:15]):
        words = text.split()
        words[rng.randrange(len(words))] = "edited"
        docs.append((10_000 + k, f"before it {text.upper()} after it"))
        docs.append((20_000 + k, "before it " + " ".join(words) + " after it"))
        docs.append((30_000 + k, " ".join(text.split()[:-1])))
    docs += [(None, "x " + items[0][1]), (7, None), (8, ""), (9, "a b"), (40_000, docs[-1][1]), (40_000, docs[-1][1])]
    items += [(900, "two words"), (901, None), (902, items[0][1])]
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, k string, n int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")
    got = {(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.item_id)): (int(r.start), round(r.similarity, 9)) for r in decontaminate.leaks(d, b).toPandas().itertuples()}
    want = brute_leaks(docs, items)
    assert len(want) > 30 and {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert (None, 0) in got
    kept = decontaminate.drop_leaks(d, b)
    assert kept.columns == d.columns and kept.count() == sum(i not in {k[0] for k in want} for i, _ in docs)
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def leaks_at_every_start(docs, items):
    """The best similarity of any window of the item's size, for every document and item that reach 0.8."""
    out = {}
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            want = item.lower().split()
            b = Counter(shingles(want))
            for s in range(max(1, len(words) - len(want) + 1)):
                a = Counter(shingles(words[s : s + len(want)]))
                sim = sum((a & b).values()) / max(1, sum((a | b).values()))
                if sim >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), round(sim, 9))
    return out


def test_leaks_in_changed_order(spark):
    """Parts of an item that stand swapped share no window start with its own places."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, items = [], []
    for i in range(24):
        item = [word() for _ in range(rng.choice([50, 60, 90]))]
        cut = len(item) // 2 if i < 8 else rng.randrange(10, len(item) - 10)
        swapped = item[cut:] + item[:cut]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([word() for _ in range(80)] + swapped + [word() for _ in range(80)])))
        docs.append((100 + i, " ".join([word() for _ in range(80)] + swapped[: len(item) // 2] + [word() for _ in range(80)])))
    items += [(50, "a b c d e " * 6), (51, "x y z " * 9)]
    docs += [(200, " ".join(word() for _ in range(30)) + " b c d e a" * 7), (201, "z x y " * 30), (202, "z x y " * 8)]
    want = leaks_at_every_start(docs, items)
    assert {(i, i) for i in range(24)} <= set(want) and {(200, 50), (201, 51), (202, 51)} <= set(want)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(d, b).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_fingerprints_of_windows(spark):
    values = [3, 3, 5, -1]
    df = spark.createDataFrame([(values,)], "sh array<long>")
    got = decontaminate.with_fingerprint(df).first().fp % (1 << 64)
    assert got == sum(1 << b for b in range(64) if 2 * sum((v % (1 << 64)) >> b & 1 for v in values) > 4)


def test_item_index_finds_all_within_the_radius(spark):
    rng = random.Random(3)
    item, near = rng.getrandbits(63), []
    for n in range(decontaminate.RADIUS + 1):
        near.append(item ^ sum(1 << b for b in rng.sample(range(63), n)))
    index = decontaminate.item_index(spark.createDataFrame([(1, 5, item)], "item_id long, size int, fp long"))
    keys = {(r.block, r.key) for r in index.collect()}
    rows = spark.createDataFrame([(v,) for v in near], "fp long").select(*[decontaminate._block(F.col("fp"), b).alias(f"b{b}") for b in range(decontaminate.BLOCKS)]).collect()
    assert all(any((b, r[f"b{b}"]) in keys for b in range(decontaminate.BLOCKS)) for r in rows)


URLS = ["http://Example.ORG/es/x?q#f", "https://a.example.org/en/12", "https://example.org/en/2", "x", None, "://", "http://org/", "http://org", "http://borg/a", "http://www.x.com/fr/", "http://x.com/FR/", "ftp://x.com:80/de/", "http://spam-farm.net#a", "http://www.spam-farm.net/p", "http://u@h/p?x=://y", "http://é.com/de/x", "http://x.com?/de/"]


def test_url_query_equals_sql(spark, tmp_path):
    table = pd.DataFrame({"page_id": range(len(URLS) + 2), "url": [*URLS, URLS[0], URLS[12]], "html": "x"})
    #: two cue words on pages 12 (twice the host's) and 13, one of them alone on 6, on a page without a host, and again on a rule's host
    table.loc[[12, 13, 18, 3, 0], "html"] = "<p>Awful</p> and VILE é"
    table.loc[[6, 14], "html"] = "awful awful awful"
    table.loc[7, "html"] = None
    table.to_parquet(tmp_path / "pages.parquet")
    texts = {12: "awful nasty vile", 13: "clean words", 6: "so nasty, Awful!", 0: "other clean words, nasty", 18: "nasty awful vile", 2: "awful", 99: None, 50: "awful unlabelled"}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}).to_parquet(tmp_path / "documents.parquet")
    #: two toxic labels on a host of mixed ones, one on a host that a rule allows, clean and null ones
    pd.DataFrame({"doc_id": [12, 13, 6, 0, 18, 2, 99], "quality": 1, "toxic": pd.array([1, 0, 1, 0, 1, None, 1], dtype="Int64")}).to_parquet(tmp_path / "labels.parquet")
    got = url_filter.op9_url_filter(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for name in ("pages", "labels", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute(url_filter.OP9_SQL).df()
    same = lambda d: sorted(d.fillna("~")[["page_id", "host", "path", "rule", "verdict"]].values.tolist())
    assert same(got) == same(want)
    assert got.set_index("page_id").verdict[12] == "block"
    found = {r.word for r in url_filter.cue_words(*[spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels")]).collect()}
    assert "awful" in found and "nasty" not in found and "clean" not in found


@pytest.mark.parametrize("shards", [1, 3])
def test_cascade_is_exact_over_the_universe(spark, shards):
    rows = spark.createDataFrame([(f"h{i}",) for i in range(3000)] + [(None,), ("",), ("h5",)], "key string")
    listed = spark.createDataFrame([(f"h{i}",) for i in range(0, 3000, 7)] + [("elsewhere",)], "key string")
    got = url_filter.mark_listed(rows, "key", listed, shards).collect()
    assert len(got) == 3003
    assert all(r.listed == bool(r.key and int(r.key[1:]) % 7 == 0) for r in got)


def test_cascade_has_levels_and_may_be_empty(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(4000)], "key string")
    cascade = url_filter.Cascade.build(keys.where("key like '%3'"), keys)
    assert len(cascade.levels) > 1
    none = url_filter.Cascade.build(keys.limit(0), keys)
    assert not none.listed([b"k1", b""]).any()
    assert url_filter.judge(keys.withColumn("url", F.concat(F.lit("http://"), "key")).limit(0), url_filter.RULES, keys).count() == 0


REGEX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    fine = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, r in REGEX.items() for m in re.finditer(r, text) if fine[k](m[0]))


PII = ["", "mail a.b@c.de, x@y and @z.de or p@q@r.st", "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "call +49 (30) 1234-5678 or +1", "0" * 400, "é😀 a@b.cd +123456789", "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "ssn 123-45-6789, order 123-45-6789, 000-12-1234"]


@pytest.mark.parametrize("text", PII)
def test_base_spans_equal_the_patterns(text):
    assert sorted((a, k, b) for k, a, b in pii.base_spans(text)) == brute_base(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.+-() @ab_é", max_size=60))
def test_base_spans_equal_the_patterns_on_any_text(text):
    assert sorted((a, k, b) for k, a, b in pii.base_spans(text)) == brute_base(text)


def test_further_kinds_need_checksum_and_context():
    kinds = lambda t: [s.kind for s in pii.more_spans(t)]
    assert kinds(PII[7]) == ["iban"] and kinds(PII[8]) == ["ssn"] and not kinds("part 123-45-6789")
    assert pii.masked("x a@b.cd y", pii.find_spans("x a@b.cd y")[1]) == "x [EMAIL] y"


def test_pii_query(spark, tmp_path):
    table = pd.DataFrame({"doc_id": pd.array([*range(len(PII)), None, 3], dtype="Int64"), "text": [*PII, None, PII[3]], "n_email": 1, "kind": "x"})
    table.to_parquet(tmp_path / "documents.parquet")
    got = pii.op10_pii(spark, str(tmp_path)).toPandas()
    assert len(got) == len(table)
    for r in got[got.doc_id.notna()].itertuples():
        rank = list(REGEX)
        base = sorted(((a, rank.index(k), k, b) for a, k, b in brute_base(PII[int(r.doc_id)])))
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k in rank]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    spans = pii.personal_data(docs).where("doc_id = 7").first().spans
    assert [s.kind for s in spans] == ["iban"] and pii.personal_data(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in toxicity.grade(docs, toxicity.train(docs, labels)).where("rejected").collect()}
    now = docs
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(now.toPandas())
    all_ids = set(docs.toPandas().doc_id)
    assert set(kept[0].doc_id) == all_ids - bad
    groups = simhash.near_duplicates(docs.where(~F.col("doc_id").isin(sorted(bad) or [-1]))).toPandas()
    assert sorted(kept[1].doc_id) == sorted(set(groups.component_id))
    items = pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    leaked = {d for d, _ in brute_leaks(kept[1][["doc_id", "text"]].values.tolist(), items)}
    assert set(kept[2].doc_id) == set(kept[1].doc_id) - leaked
    assert set(kept[3].doc_id) == set(kept[2].doc_id) and not any(pii.base_spans(t) and any(k == "email" for k, *_ in pii.base_spans(t)) for t in kept[3].text)
    assert set(kept[4].doc_id) == set(kept[3].doc_id) and kept[4].length.max() <= 2048
    whole = corpus_pipeline.run(spark, sf).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole[cols].values.tolist()) == sorted(kept[4][cols].values.tolist())


def test_modules_have_queries():
    from sluice.llm import registry

    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in registry.QUERIES] and len(registry.QUERIES) == 13
    assert hmm.STATES > 1 and packing.SHARD_PIECES > 1
