"""The ten operators and the pipeline against plain versions, on the small tables and on awkward rows."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from loomspark.llm import common, contamination, html, language, licenses, mixing, quality, queries, sharding, simhash, slots, substrings, tokens
from loomspark.llm.licenses import SuffixAutomaton

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
ROWS = [
    (1, None, None, None), (2, "", "a", "en"), (3, " \t\n", None, "en"), (4, "One", "a", None), (5, "one", "b", "fr"), (6, "ONE", "b", "fr"), (7, LONG, "c", "en"), (8, LONG + " tail", "c", "en"),
    (9, "lead in " + PASSAGE + " then out", "a", "en"), (10, PASSAGE, "a", "en"), (11, "x " + PASSAGE, None, None), (12, PASSAGE, "a", "en"), (13, "été œuvre 日本語   ß <|endoftext|> don't", "d", "fr"),
    (14, "all rights reserved by cc by cc BY General Public License", "d", "en"), (15, "a b c " * 40, "d", "en"), (16, "#*$%&|<> line\nline\nline\n\n", "d", "de"), (17, "a b", "e", "de"), (18, "12 34", "e", "de"),
]
KIND = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()), StructField("lang", StringType()), StructField("n_chars", LongType())])
#: Columns named like those that operators add.
CLASHING = ("size", "key", "fp", "rank", "target", "copies", "shard", "slot", "bucket", "tab", "crc")


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame([(i, t, s, g, len(t or "")) for i, t, s, g in ROWS], KIND)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("other"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def both(awkward, tables):
    """(rows as a DataFrame, {doc_id: text}) of the awkward rows and of the small table."""
    return [(awkward, {i: t for i, t, *_ in ROWS}), tables]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_mixing(awkward, tables, empty):
    for docs in (awkward, tables[0]):
        rows = mixing.mix(docs).select("doc_id", "source", "text", "size", "source_size", "target", "copies").collect()
        sizes, taken = Counter(), Counter()
        for r in rows:
            assert r.size == len(brute.words(r.text))
            sizes[r.source] += r.size
            taken[r.source] += r.size * r.copies
            assert 0 <= r.copies <= 2
        want = brute.targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        for s in sizes:
            short = max(len(brute.words(r.text)) for r in rows if r.source == s)
            assert want[s] - short <= taken[s] <= want[s] + 1
        again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
        assert again == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mix(empty).collect() == []


def test_knapsack_fits():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reach = {r + n * j for r in reach for j in range(c + 1)}
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert (taken * lengths).sum() == max(r for r in reach if r <= budget)


def test_tokens(both, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for docs, texts in both:
        got = by_id(tokens.count_tokens(docs, path))
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    doubled = tokens.count_tokens(both[0][0].union(both[0][0]), path)
    assert doubled.count() == 2 * len(ROWS) and doubled.distinct().count() == len(ROWS)
    assert tokens.count_tokens(empty, path).collect() == []


def test_simhash(both, empty, tables):
    for docs, texts in both:
        got, fps = by_id(simhash.link_fingerprints(docs)), {i: brute.fingerprint(t) for i, t in texts.items()}
        assert {i: r.fp % 2**64 for i, r in got.items()} == fps
        assert {i: r.component_id for i, r in got.items()} == brute.components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert simhash.link_fingerprints(empty).collect() == []


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    for flips in (0, 1, 2):
        a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
        keys = []
        for f in (a, b):
            sets = defaultdict(set)
            for row, key in zip(*simhash.golay_keys(f)):
                sets[row].add(key)
            keys.append(sets)
        assert all(keys[0][i] & keys[1][i] for i in range(300))


def test_crowded_keys_link_alike(spark):
    rng = np.random.default_rng(2)
    base, fps = 0x0123456789ABCDEF, set()
    for _ in range(300):
        f = base
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            f ^= 1 << int(b)
        fps.add(f - (1 << 64) if f >> 63 else f)
    links = simhash.fingerprint_links(spark.createDataFrame([(0, f) for f in fps], "tab int, fp long"))
    want = brute.components(fps, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    got = {r.node: r.component for r in common.components(links).collect()}
    groups = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert groups(got) == groups(want)


def _edited(words, rng, n):
    w = list(words)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"edit{rng.integers(1 << 30)}"
    return " ".join(w)


def test_near_duplicates(spark, awkward, empty):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = [f"t{rng.integers(400)}" for _ in range(300)]
        rows += [(1000 * g + 1, " ".join(base)), (1000 * g + 2, " ".join(base)), (1000 * g + 3, _edited(base, rng, 2)), (1000 * g + 4, _edited(base, rng, 4)), (1000 * g + 5, _edited(base, rng, 60))]
    base = [f"z{rng.integers(400)}" for _ in range(300)]
    rows += [(90_000, " ".join(base))] + [(90_001 + i, _edited(base, rng, 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fps", F.lit(1))
    gone = {r.doc_id: r.keeper for r in simhash.near_duplicates(docs).collect()}
    want = {1000 * g + i: 1000 * g + 1 for g in range(12) for i in (2, 3, 4)} | {90_001 + i: 90_000 for i in range(200)}
    assert gone.items() <= want.items() and len(gone) >= 0.99 * len(want)
    left = simhash.deduplicated(awkward)
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 7, 9, 13, 14, 15, 16, 17, 18] and left.columns == awkward.columns
    assert simhash.deduplicated(empty).collect() == []


def _keepers(spark, texts):
    """(found, right) keepers, by near_duplicates and by all pairs."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: set(zip(*(t.lower().split()[j:] for j in range(5)))) for i, t in texts.items()}
    groups = brute.components(texts, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return {r.doc_id: r.keeper for r in simhash.near_duplicates(docs).collect()}, {i: g for i, g in groups.items() if i != g}


def test_near_duplicates_with_blocks(spark):
    rng, texts = np.random.default_rng(11), {}
    for g in range(40):
        base = [f"g{g}w{i}" for i in rng.permutation(300)]
        for n, share in enumerate((0.1, 0.15, 0.24)):
            block = [f"n{rng.integers(1 << 40)}" for _ in range(int(300 * share))]
            cut = int(rng.integers(300 - len(block)))
            texts[100 * g + 10 * n] = " ".join(base)
            texts[100 * g + 10 * n + 1] = " ".join(base + block)
            texts[100 * g + 10 * n + 2] = " ".join(base[:cut] + block[: len(block) // 3] + base[cut + len(block) // 3 :])
            base = [f"{w}x" for w in base]
    found, right = _keepers(spark, texts)
    assert found == right and len(right) == 240

def test_near_duplicates_of_one_vocabulary(spark):
    rng, words = np.random.default_rng(12), np.array([f"v{i}" for i in range(200)])
    texts = {0: " ".join(words)}
    for g in range(1, 30):
        order = rng.permutation(words).tolist()
        texts |= {10 * g: " ".join(order), 10 * g + 1: " ".join(order[100:] + order[:100])}
    found, right = _keepers(spark, texts)
    assert found == right and len(right) == 29

def test_near_duplicates_in_crowded_keys(spark, monkeypatch):
    rng, base = np.random.default_rng(13), [f"c{i}" for i in range(300)]
    texts = {i: _edited(base, rng, 1) for i in range(200)}
    for g in range(30):  # the same words in another order, so in the same keys, but unlike the others
        other = rng.permutation(base).tolist()
        texts |= {1000 + 10 * g + i: _edited(other, rng, 1) for i in range(2)}
    found, right = _keepers(spark, texts)
    assert found == right
    monkeypatch.setattr(simhash, "FAMILY_BLOCK", 5_000)
    assert _keepers(spark, texts)[0] == right


def test_deduplicated_by_words_where_ids_repeat_or_lack(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (2, "  " + one.upper() + "\n"), (2, two), (2, two), (3, "\t" + two), (None, three), (None, three + " "), (None, one), (None, None), (None, ""), (5, three + " ü"), (4, "Ü x")]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    found = Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in left.collect())
    assert found == Counter([(1, one), (2, two), (5, three + " ü"), (None, ""), (4, "ü x")])


def test_links_inside_connect_all_pairs():
    rng = np.random.default_rng(14)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12))) for _ in range(25)]
        alike = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
        links = set(simhash.links_inside(sets, 0.8))
        assert brute.components(range(25), lambda a, b: (a, b) in links or (b, a) in links) == brute.components(range(25), alike)
        assert all(alike(a, b) for a, b in links)


def test_decontamination(spark, both, empty, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    own = spark.createDataFrame([(1, "Shared0 shared1, shared2 SHARED3 shared4 shared5"), (2, "a  b"), (3, None), (4, "..."), (5, "A b!"), (6, " ".join(f"w{i}x{i}" for i in range(20)))], "item_id long, text string")
    for (docs, texts), items in zip(both, (own, bench)):
        got = {r.doc_id: (r.item_id, r.containment, r.n_items) for r in contamination.contaminated(docs, items).collect()}
        assert got == brute.contained(texts, {r.item_id: r.text for r in items.collect()})
        left = contamination.decontaminated(docs, items)
        assert {r.doc_id for r in left.collect()} == texts.keys() - got.keys() and left.columns == docs.columns
    assert contamination.contaminated(empty, own).collect() == []
    assert contamination.contaminated(tables_docs(both), own.limit(0)).collect() == []


def tables_docs(both):
    return both[1][0]


def test_decontamination_runs_no_python(both, spark, folder):
    plan = contamination.contaminated(both[1][0], spark.read.parquet(f"{folder}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_substrings(spark, both, empty, monkeypatch):
    rows = [(i, f"{'lead ' * (i % 3)}{PASSAGE} {'mid ' * (i % 2)}{PASSAGE} own{i}") for i in range(40)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), dict(rows)
    for crowded, gathered in ((substrings.CROWDED, substrings.GATHERED), (2, substrings.GATHERED), (10**9, 3)):
        monkeypatch.setattr(substrings, "SAMPLED", 1.0 if crowded == 2 else substrings.SAMPLED)
        monkeypatch.setattr(substrings, "CROWDED", crowded)
        monkeypatch.setattr(substrings, "GATHERED", gathered)
        for docs, texts in [*both, many]:
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
            assert got == brute.removed_words(texts)
    assert substrings.dedup_substrings(empty).collect() == []


def test_spans_in_buckets_of_any_size(monkeypatch):
    rng = np.random.default_rng(31)
    for gathered in (3, 10, 10**6):
        monkeypatch.setattr(substrings, "GATHERED", gathered)
        rows = []
        for doc in range(12):
            words = [b"%d" % x for x in rng.integers(0, 2, 40)]
            rows.append((7, doc, doc, 0, len(words) - 12, b" ".join(words)))
        want = set()
        for _, doc, _, _, n, text in rows:
            w = text.split()
            earlier = {tuple(t.split()[i : i + 13]) for _, d, _, _, m, t in rows if d < doc for i in range(m)}
            want |= {(doc, i) for i in range(n) if tuple(w[i : i + 13]) in earlier}
        first = [r for b in substrings._spans_in_buckets(iter([substrings._batch(rows[:5]), substrings._batch(rows[5:])])) for r in b.to_pylist()]
        onward = sorted((r["bucket"], r["doc_id"], r["crc"], r["start"], r["size"], r["packed"]) for r in first if r["packed"])
        second = [r for b in substrings._spans_in_buckets(iter([substrings._batch(onward)])) for r in b.to_pylist()]
        found = {(r["doc_id"], r["start"] + i) for r in first + second if r["packed"] is None for i in range(r["size"])}
        assert found == want and not [r for r in second if r["packed"]]


def test_shared_slots_are_exact(spark):
    rng = np.random.default_rng(33)
    rows = [np.unique(rng.integers(-(2**63), 2**63, 50)) for _ in range(30)]
    common = rng.integers(-(2**63), 2**63, 5)
    rows = [np.unique(np.concatenate([r, common])) if i % 3 else r for i, r in enumerate(rows)]
    batches = []
    for part in (rows[:7], rows[7:8], rows[8:]):
        counter = slots.SlotCounter()
        for r in part:
            counter.add(r)
        batches += counter.settle().to_pylist()
    bits, crowds = slots.shared_slots(spark.createDataFrame([(b["block"], b["counts"], b["n"]) for b in batches], slots.COUNTS), 10)
    counts = Counter(s for r in rows for s in set(slots.slot_of(r).tolist()))
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {s for s, n in counts.items() if n > 1}
    assert crowds.tolist() == sorted(s for s, n in counts.items() if n >= 10)
    counter = slots.SlotCounter(2)
    for r in rows:
        counter.add(r)
    bits, _ = slots.shared_slots(spark.createDataFrame([(b["block"], b["counts"], b["n"]) for b in counter.settle().to_pylist()], slots.COUNTS), tables=2)
    assert slots.held(bits, common, 2).all() and not slots.held(bits, rows[0], 2).any()


def test_cutter_is_blind_to_place():
    rng, cutter = np.random.default_rng(32), substrings.Cutter()
    words = [b"w%d" % x for x in rng.integers(0, 50, 400)]

    def minimisers(part):
        return {i + k: m for m, i, n in zip(*(x.tolist() for x in cutter.cut(part))) for k in range(n)}

    whole = minimisers(words)
    assert sorted(whole) == list(range(len(words) - 12))
    for a in (1, 17, 300):
        assert {i: m for i, m in minimisers(words[a:]).items()} == {i - a: m for i, m in whole.items() if i >= a}


def test_sharding(both, empty):
    for docs, texts in both:
        rows = sharding.shard(docs).collect()
        assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()}
        shards = defaultdict(list)
        for r in rows:
            shards[r.shard].append(r.slot)
        n = len(rows)
        assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and set(shards) <= set(range(24))
        counts = [len(shards.get(s, ())) for s in range(24)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == n
    assert sharding.shard(empty).collect() == []


def test_shards_prune_by_every_dimension(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    rows = sharding.shard(docs, 24).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    of = {"source": lambda r: r.source, "lang": lambda r: r.lang, "size": lambda r: r["size"].bit_length()}
    for dimension, value in of.items():
        met, scattered = defaultdict(set), defaultdict(set)
        for r in rows:
            met[value(r)].add(r.shard)
            scattered[value(r)].add(zlib.crc32(str(r.doc_id).encode()) % 24)
        assert sum(map(len, met.values())) <= 0.8 * sum(map(len, scattered.values())), dimension
    order = sorted((r.shard, r.slot, r.curve) for r in rows)
    assert [c for *_, c in order] == sorted(r.curve for r in rows)


def test_hilbert_curve_is_one_path():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    index = sharding.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_html(spark, folder, empty):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got.keys() == {r.page_id for r in pages.collect()}
    for r in got.values():
        assert r.n_chars == len(r.text) and "track(" not in r.text
    own = [
        (1, None), (2, ""), (3, "<p>unclosed <b>x"), (4, "\x00<<>>&&amp;"),
        (5, "<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=sidebar><p>Most read today</p></div><article><h1>Title &amp; more</h1><p>First   para,\n with text that goes on for a while.</p><p>Second para, which also has some words.</p></article>"
            "<section id=comments><div class=comment><p>I think this is wrong, honestly.</p></div></section><form><label>Mail</label><input></form><footer>&copy; 2024 All of us.</footer></body>"),
        (6, "<div>" * 5000 + "deep"),
    ]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([(i, "u", h) for i, h in own], "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1] == got[2] == "" and len(got) == 6
    assert got[5] == "Title & more\nFirst para, with text that goes on for a while.\nSecond para, which also has some words."
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


class OtherPages:
    """Pages of a generator that the model doesn't know: real words, other layouts and names, known main text."""

    SAID = ("The council met on Tuesday to discuss the new budget.", "Nobody expected the river to rise that quickly, she said.", "It was late.", "Prices have gone up again, for the third time this year!", "He walked home, slowly, along the canal.")

    def __init__(self, seed):
        import random

        self.rng = random.Random(seed)

    def text(self, low, high):
        return " ".join(self.rng.choice(self.SAID) for _ in range(self.rng.randint(low, high)))

    def page(self):
        """(html, main text)"""
        r, blocks, inside = self.rng, [], []
        for i in range(r.randint(3, 9)):
            said = self.text(1, 4) if i else "A title for the story"
            blocks.append(said)
            tag = "h1" if not i else r.choice(["p", "p", "p", "div", "blockquote"])
            inside.append(f"<{tag}>{said.replace('said', '<em>said</em>')}" + ("" if tag == "p" and r.random() < 0.3 else f"</{tag}>"))
        shell = r.choice([("<article>", "</article>"), ("<main id=maincontent>", "</main>"), ("<div class='storytext entry-body'>", "</div>"), ("<section itemprop='articleBody'>", "</section>")])
        talk = "".join(f"<li class='u{i}'><cite>Ann {i}</cite><p>{self.text(1, 2)}</p><a href=#>Answer</a></li>" for i in range(r.randint(1, 5)))
        before = ["<div role=navigation class=mainnav>" + "".join(f"<a href=/{w}>{w}</a> " for w in ("Home", "World", "Sport", "Money")) + "</div>", "<div class='cookie-bar'><p>We use cookies. Is that fine?</p><button>Yes</button></div>", "<header><a href=/><img src=l></a><p>News you can use</p></header>"]
        after = [f"<section class='discussion'><h2>Join in</h2><ol>{talk}</ol></section>", "<aside class=side-rail><h3>Most read</h3><ul>" + "".join(f"<li><a href=/{i}>Story number {i} of the day</a>" for i in range(5)) + "</ul></aside>", "<div class='ad-slot'>Buy now, pay later!</div>", "<footer><p>&copy; 2020 The Daily. All rights kept.</p><a href=/c>Contact</a></footer>"]
        page = "".join(r.sample(before, r.randint(1, 3))) + shell[0] + "".join(inside) + shell[1] + "".join(r.sample(after, r.randint(1, 4)))
        head = r.choice(["<head><title>T</title></head><body>", "<head><title>T</title><body>", "<title>T</title>"])
        return f"<!doctype html><html>{head}<div class='{r.choice(['outer', 'page'])}'>{page}</div>", "\n".join(blocks)


def test_main_text_of_unseen_layouts():
    evidence, trees = html.model()
    maker = OtherPages(99)
    pages = [maker.page() for _ in range(200)]
    found = list(html.main_texts((p for p, _ in pages), evidence, trees))
    right = kept = wanted = 0
    for (_, want), got in zip(pages, found):
        a, b = Counter(got.split("\n")), Counter(want.split("\n"))
        right, kept, wanted = right + (a & b).total(), kept + a.total(), wanted + b.total()
    assert right >= 0.95 * kept and right >= 0.95 * wanted, (right, kept, wanted)
    assert np.mean([g == w for g, (_, w) in zip(found, pages)]) >= 0.8


def test_main_text_of_broken_pages():
    def text(page):
        return next(html.main_texts([page], *html.model()))

    story = "<article><h1>Hi there</h1><p>Some text here, which goes on for a while.</p></article>"
    want = "Hi there\nSome text here, which goes on for a while."
    assert text(f"<head><title>T</title><body>{story}") == text(f"<head><title>T</title>{story}") == text(f"<title>T{'</title>'}{story}") == want
    assert text(f"<body>{story}<a href='") == text(f"<body>{story}<!-- x") == text(f"<body>{story}<div class") == want
    assert text("<div>" * 5000 + story) == want
    assert text(f"<body>{story}<section class='discussion'><h3>Talk</h3><div><b>Ann</b><p>I think so.</p></div><div><b>Bo</b><p>Not me.</p></div></section>") == want
    assert text("<p title='a>b' data-x=\"<i>\">one &lt; two &amp;amp; <script>var x='</p>'</script>three, four and five words.</p>") == "one < two &amp; three, four and five words."
    long = "<article>" + "<p>A sentence of a long page, which has many of them.</p>" * 30_000 + "</article>"
    assert text(long).count("\n") == 29_999
    for odd in ("<b>" * 100_000 + "x</i>" * 1000, "<div>" * 100_000 + "x</p>" * 50_000, "<a " + "b='" * 200_000, "<!--" * 200_000, "<p>" + "< " * 200_000):
        html.parse(odd)


def test_boosted_trees_and_decoding():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = html.BoostedTrees().fit(x[:2000], y[:2000])
    assert np.mean((trees.log_odds(x[2000:]) > 0) == y[2000:]) >= 0.95
    for _ in range(50):
        n = int(rng.integers(1, 9))
        up = [0] + [int(rng.integers(i)) for i in range(1, n)]
        direct, odds = rng.integers(0, 50, n).tolist(), (rng.normal(size=n) * 3).tolist()

        def worth(label):
            own = sum(max(-6, min(6, o)) * (0.2 + np.log1p(d) / 4) for o, d, v in zip(odds, direct, label) if v)
            return own - sum(label[i] != label[up[i]] for i in range(1, n))

        every = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert worth(html.decode(up, direct, odds)) == pytest.approx(max(map(worth, every)))


def test_quality(both, empty):
    for docs, texts in both:
        got = by_id(quality.quality(docs))
        for i, t in texts.items():
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
            assert not (r.base_failed and r.kept)
        kept = quality.good(docs)
        assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == docs.columns
    assert quality.quality(empty).collect() == []


def test_quality_limits_bind_below_the_base():
    fresh, least = (f"q{i}" for i in range(10**6)), quality.MIN_REPEAT

    def text(n, *repeats):
        """n words, with passages of the given lengths and times in them."""
        parts = [p for length, times in repeats for p in [[next(fresh) for _ in range(length)]] * times]
        rest = n - sum(map(len, parts))
        return " ".join(w for i in range(rest) for w in [next(fresh), *(parts.pop() if parts and i % 7 == 6 else ())]).encode()

    def verdict(t):
        n, _, _, _, _, top, share, failed, kept = quality.measure(t)
        return share > quality.MAX_COVERED, top >= least and top > quality.MAX_LONGEST * n, failed, kept

    assert verdict(text(1000, *[(10, 2)] * 6)) == (True, False, False, False)
    assert verdict(text(1000, (45, 2))) == (False, True, False, False)
    assert verdict(text(1000, (30, 2))) == (False, False, False, True)
    assert not verdict(text(200, (48, 2)))[-1] and not verdict(text(200, (12, 8)))[-1]


def test_suffix_array_repeats():
    rng = np.random.default_rng(6)
    for _ in range(40):
        items = rng.integers(0, 3, rng.integers(0, 40))
        assert quality.longest_repeats(items).tolist() == brute.longest_repeats(items.tolist())


def test_language(spark, awkward, empty, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    rows = language.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    got = by_id(language.predict_language(awkward))
    assert len(got) == len(ROWS) and all(got[i].lang_pred == "und" for i in (1, 2, 3, 18))
    assert language.predict_language(empty).collect() == []


def test_language_sample_is_bounded_and_balanced(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 400 == 0, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"), F.concat(F.repeat(F.lit("some text "), 300), F.col("id").cast("string")).alias("text"))
    rows = language.sample(docs.union(docs.limit(0)).repartition(7)).collect()
    found = Counter(r.lang for r in rows)
    assert found["a"] == found["b"] == language.FIT_DOCS // 3 and found["rare"] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 40_000, 400))
    assert max(len(r.part) for r in rows) <= language.WINDOW * language.FIT_WINDOWS


def test_network_forward_and_gradients():
    rng = np.random.default_rng(9)
    net = language.ByteConvNet(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 5)

    def plain(row):
        """One window, filter by filter and place by place."""
        e, pooled = net.p["embed"][row], []
        for w in language.WIDTHS:
            at = [e[i : i + w].ravel() @ net.p[f"w{w}"] + net.p[f"b{w}"] for i in range(len(row) - w + 1)]
            pooled += [max(0.0, max(v[f] for v in at)) for f in range(language.FILTERS)]
        z = np.array(pooled) @ net.p["out"] + net.p["bias"]
        return z - np.log(np.exp(z - z.max()).sum()) - z.max()

    assert np.allclose(net.log_softmax(x), [plain(r) for r in x], atol=1e-6)
    grads, step = net._gradients(x, y), 1e-5
    loss = lambda: -net.log_softmax(x)[np.arange(5), y].mean()
    for name, g in grads.items():
        for place in rng.choice(g.size, min(3, g.size), replace=False):
            flat = net.p[name].reshape(-1)
            kept = flat[place]
            flat[place] = kept + step
            up = loss()
            flat[place] = kept - step
            down = loss()
            flat[place] = kept
            assert g.reshape(-1)[place] == pytest.approx((up - down) / (2 * step), abs=2e-5)


def test_licenses(both, empty):
    for docs, texts in both:
        got = by_id(licenses.license_scan(docs))
        for i, t in texts.items():
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licences(t)
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert all(s.label in r.labels.split(",") and 0 <= s.first_word <= s.last_word < r.n_words for s in r.spans)
    assert licenses.license_scan(empty).collect() == []


LICENCES = {
    "Intro. Released, under THE mit (license)! x": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "the Mozilla Public License 2.0 applies": "mpl-2.0",
    "BSD 3-Clause License": "bsd",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "under the GNU Lesser General Public License": "gpl,lgpl",
    "under the GNU Affero General Public License": "agpl,gpl",
    "Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa",
    "released under the bsd thing": "",
    "licensed under the Apache License, version 1.1": "",
    "the river and the house": "",
}


def test_licences_by_label():
    assert {t: licenses.scan(t.encode())[5] for t in LICENCES} == LICENCES


def test_licence_labels_and_score_against_brute_force():
    rng = np.random.default_rng(21)
    _, labels, widths = licenses._templates()
    wording = [licenses._words(line.encode()) for text in licenses.TEMPLATES.values() for line in text.strip().split("\n")]
    def chained(found, width):
        """Most template words that matches cover in order, by trying every match as the one before."""
        most = []
        for end, place, size in found:
            words, begin = size, end - size
            for (e, p, _), (w, first) in zip(found, most):
                gain = min(size, place - p, end - e)
                if gain > 0 and end - first <= width + width // 8 and (w + gain, first) > (words, begin):
                    words, begin = w + gain, first
            most.append((words, begin))
        return max(w for w, _ in most)

    for _ in range(40):
        words = []
        for _ in range(3):
            own = list(wording[rng.integers(len(wording))])
            for place in rng.integers(0, len(own), rng.integers(0, 3)):
                own[place] = "other"
            words += ["filler"] * int(rng.integers(0, 4)) + own
        by_template = defaultdict(list)
        for number, template in enumerate(wording):  # every pair of equal runs that can go on neither way
            for i in range(len(words)):
                for j in range(len(template)):
                    if words[i] == template[j] and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                        n = 1
                        while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                            n += 1
                        if n >= licenses.MIN_MATCH:
                            by_template[number].append((i + n, j + n, n))
            by_template[number].sort()
        covered = {number: chained(found, widths[number]) / widths[number] for number, found in by_template.items() if found}
        whole = {labels[n] for n, c in covered.items() if c >= (1 if widths[n] < licenses.SHORT else licenses.MIN_COVER)}
        base = set(filter(None, brute.licences(" ".join(words))[-1].split(",")))
        got = licenses.scan(" ".join(words).encode())
        assert set(filter(None, got[5].split(","))) == base | whole
        assert got[6] == pytest.approx(1.0 if base else max(covered.values(), default=0.0))


def test_automaton_matches():
    rng = np.random.default_rng(8)
    for _ in range(30):
        patterns = [[str(x) for x in rng.integers(0, 3, rng.integers(1, 9))] for _ in range(3)]
        text = [str(x) for x in rng.integers(0, 3, 30)]
        held = {tuple(p[a:b]) for p in patterns for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
        longest = [max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in held), default=0) for i in range(len(text))]
        automaton = SuffixAutomaton(patterns)
        assert [(e, n) for e, n, _ in automaton.statistics(text)] == [(i + 1, n) for i, n in enumerate(longest)]
        want = set()
        for k, p in enumerate(patterns):
            for i in range(len(text)):
                for j in range(len(p)):
                    n = 0
                    while n <= min(i, j) and text[i - n] == p[j - n]:
                        n += 1
                    if n >= 2 and (i + 1 == len(text) or j + 1 == len(p) or text[i + 1] != p[j + 1]):
                        want.add((k, i + 1, j + 1, n))
        found = list(automaton.matches(text, 2))
        assert len(found) == len(set(found)) and set(found) == want


ODD = ("_text", "_kept", "_doc", "_draw", "_source", "_size", "_last", "_row", "_at", "_part", "_place", "node", "digest", "prefix", "row", "draw", "key", "its", "n", "some", "value", "place")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, one very long text and further columns with clashing names."""
    long = "w " * 300_000 + "end"
    rows = [(None, None, None, None), (None, "no id here", "a", "en"), (None, "no id here", "a", "en"), (1, PASSAGE, "a", "en"), (1, PASSAGE, "a", "en"), (1, "other text of one", "a", "en"), (2, PASSAGE + " more", None, None), (3, long, "b", "fr"), (3, long, "b", "fr")]
    df = spark.createDataFrame([(i, t, s, g, len(t or "")) for i, t, s, g in rows], KIND)
    for c in ODD:
        df = df.withColumn(c, F.lit("other"))
    return df.repartition(2), rows


ROW_BY_ROW = {
    "tokens": lambda d: tokens.count_tokens(d, __import__("public_tokenizers").path("word_bpe_49k.json")),
    "simhash": simhash.link_fingerprints,
    "substrings": substrings.dedup_substrings,
    "quality": quality.quality,
    "language": language.predict_language,
    "licenses": lambda d: licenses.license_scan(d).drop("spans"),
}


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_odd_rows_each_give_one(odd, name):
    docs, rows = odd
    got = Counter(ROW_BY_ROW[name](docs).collect())
    assert got.total() == len(rows)
    assert Counter(r.doc_id for r in got.elements()) == Counter(i for i, *_ in rows)
    assert sum(n > 1 for n in got.values()) >= 3  # repeated rows get equal results


def test_odd_rows_in_mixing_and_sharding(odd):
    docs, rows = odd
    mixed = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == Counter((i, t) for i, t, *_ in rows)
    taken = Counter()
    for r in mixed:
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 2 and r.digest == "other"
    for r in mixed:
        assert taken[r.source] <= r.target + 1
    assert mixing.mixed_rows(docs).columns == docs.columns
    placed = sharding.shard(docs, 4, whole=True)
    assert Counter((r.doc_id, r.text) for r in placed.collect()) == Counter((i, t) for i, t, *_ in rows)
    assert len({(r.shard, r.slot) for r in placed.collect()}) == len(rows) and set(docs.columns) <= set(placed.columns)


def test_odd_rows_in_filters(spark, odd):
    docs, rows = odd
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter({(i, t) for i, t, *_ in rows} - {(2, PASSAGE + " more")})
    bench = spark.createDataFrame([(1, "no id here"), (2, PASSAGE)], "item_id long, text string").withColumn("_doc", F.lit(1))
    left = contamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and not {r.doc_id for r in left.collect()} & {None, 1, 2}
    assert quality.good(docs).columns == docs.columns


def test_equal_rows_are_taken_by_number(spark):
    rows = [(7, "one two three", "a")] * 10 + [(8, "four five six", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(docs, budget=1.0, weights=(1,)).collect()
    assert sum(r.copies * r["size"] for r in mixed) == 33
    mixed = mixing.mix(docs, budget=0.5, weights=(1,)).collect()
    assert sum(r.copies * r["size"] for r in mixed) == 15 and {r.copies for r in mixed} <= {0, 1}


def test_knapsack_of_long_documents():
    rng = np.random.default_rng(17)
    lengths = np.unique(rng.integers(21_000, 25_194, 600))
    taken = mixing.fit_counts(lengths, np.ones(len(lengths), np.int64), 9_000_000)
    assert taken.max() <= 1 and 9_000_000 - 6 <= (taken * lengths).sum() <= 9_000_000
    lengths, counts = np.unique(rng.integers(1, 40_000, 5000)), None
    counts = rng.integers(1, 2000, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    taken = mixing.fit_counts(lengths, counts, budget)
    assert (taken <= counts).all() and (taken * lengths).sum() == budget


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(200, 201), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in common.components(path).collect()} == {i: 0 for i in range(51)} | {200: 200, 201: 200}
    assert common.components(path.limit(0)).collect() == []


def test_queries_give_their_columns(spark, folder):
    from oracle import connect, differences

    con = connect(folder)
    for name, sql in queries.oracle_sql().items():
        assert differences(queries.queries()[name](spark, folder), con, sql) == ""
    columns = {
        "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op3_simhash": ["doc_id", "fingerprint", "component_id"],
        "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op8_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    assert {n: queries.queries()[n](spark, folder).columns for n in columns} == columns


def test_pipeline(spark, folder, tables):
    docs, texts = tables
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    good = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    words = {i: texts[i].lower().split() for i in good}
    sets = {i: set(zip(*(w[j:] for j in range(5)))) for i, w in words.items()}
    groups = brute.components(good, lambda a, b: words[a] == words[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    alone = {i for i, first in groups.items() if i == first}
    assert len(alone) < len(good)
    clean = alone - brute.contained({i: texts[i] for i in alone}, bench).keys()
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.where(F.col("doc_id").isin(list(clean)))).collect()}
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
    assert all(r.text == texts[r.doc_id] for r in rows) and set(docs.columns) <= set(rows[0].asDict())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, folder):
    for docs in (odd[0], empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            path = f"{common.application_folder(spark)}/test/{name.replace(' ', '-')}-{len(columns)}"
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            assert set(columns) <= set(docs.columns) and (name == "sharding" or docs.columns == columns)


def test_plans_keep_to_built_in_expressions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    for df in (sharding.shard(docs), simhash.deduplicated(docs), contamination.decontaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))):
        assert "Cartesian" not in df._jdf.queryExecution().toString()


def test_shared_folder_is_required_on_clusters():
    class Context:
        master = "spark://host:7077"
        applicationId = "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        common.checkpoint_folder(Session())


@pytest.mark.parametrize("scale", [1, 1000])  # below and above 2^22 words
def test_mixing_takes_an_equal_share_of_every_length(scale):
    rng = np.random.default_rng(23)
    lengths, counts = np.unique(np.minimum(20_000, np.exp(rng.normal(5, 1.2, 2500))).astype(np.int64) + 1, return_counts=True)
    counts = counts * scale
    for share in (0.25, 0.5, 0.8):
        budget = int((lengths * counts).sum() * share)
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken * lengths).sum() == budget and (taken <= counts).all()
        place = np.cumsum(counts) - counts
        for q in range(4):
            own = (place * 4 >= q * counts.sum()) & (place * 4 < (q + 1) * counts.sum())
            assert abs(taken[own].sum() / counts[own].sum() - share) < 0.05


def test_knapsack_beside_a_text_of_twenty_million_words():
    lengths, counts = np.array([3, 10, 400, 20_000_000]), np.array([50, 2000, 300, 3])
    taken = mixing.fit_counts(lengths, counts, 40_070_003)
    assert (taken * lengths).sum() == 40_070_003
    assert mixing.fit_counts(np.array([20_000_000]), np.array([4]), 45_000_000).tolist() == [2]
    small = mixing.fit_counts(lengths, counts, 30_000)  # the long text doesn't fit
    assert (small * lengths).sum() == 30_000


def test_windows_at_the_bound_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", 10**9)
    text = " ".join(f"w{i}" for i in range(13))
    for rows in ([(1, text)] * 2 + [(2, text)], [(1, f"{text} {text}"), (2, text)], [(1, text)] * 4 + [(2, text), (3, text)], [(2, text)] * 6 + [(1, text)]):
        for gathered in (1, 2, 3, 4):
            monkeypatch.setattr(substrings, "GATHERED", gathered)
            got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
            want = brute.removed_words(dict(rows))
            assert got == Counter((i, *want[i]) for i, _ in rows)


def test_a_row_repeated_often_has_its_spans_once(spark):
    text = PASSAGE + " own words here"
    one = spark.createDataFrame([(2, text)], "doc_id long, text string")
    docs = one.crossJoin(spark.range(100_000)).drop("id").union(spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string"))
    spans = substrings.repeated_spans(docs).collect()
    assert [(r.doc_id, list(r.starts), list(r.ends)) for r in spans] == [(2, [0], [40])]


def test_items_of_one_opening_make_no_pairs_of_all(spark):
    opening = "which of the following statements about this passage is the true one"
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(F.lit(opening), F.expr("concat_ws(' ', transform(sequence(0, 39), k -> concat(' i', id, 'x', k)))")).alias("text"))
    sketch = contamination.item_sketches(items, 0.8, 5).select(F.explode("sketch").alias("hash"), "item", "need")
    held = items.where("item_id % 1000 = 0").select("item_id", "text")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit(opening), F.expr("repeat(concat(' only', id), 200)")).alias("text")).union(held)
    words = docs.select("doc_id", contamination._words(F.col("text")).alias("w")).select("doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    rows = words.select("doc_id", contamination._hashes(F.col("w"), 5).alias("h")).select("doc_id", F.size("h").alias("m"), F.explode_outer("h").alias("hash"))
    assert contamination.candidate_pairs(rows, sketch).count() == 10
    assert {r.doc_id: r.item_id for r in contamination.contaminated(docs, items).collect()} == {i: i for i in range(0, 10_000, 1000)}


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"l{i % 400}", " ".join(chr(97 + i % 400 % 26) + chr(97 + i % 400 // 26) * 3 for _ in range(20))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = Counter(r.lang for r in language.sample(docs).collect())
    assert len(found) == 400 and max(found.values()) <= language.FIT_DOCS // 400
    monkeypatch.setattr(language, "FIT_DOCS", 399)
    with pytest.raises(ValueError, match="FIT_DOCS"):
        language.sample(docs)
