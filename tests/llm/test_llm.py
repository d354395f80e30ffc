"""The training-data operators: odd inputs, and brute-force versions on small tables."""

from __future__ import annotations

import gzip
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirelake.llm import ann, common, html_main, langid, licences, mixing, ngram_join, packing, pii, quality, queries, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 700} and" for i in range(30_000))
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, LONG, "en", None), (4, "The cat. The cat.", "en", "b"), (4, "The cat. The cat.", "en", "b"), (5, "12 34 !!", None, None), (None, "Der Hund und die Katze", "de", "b")]
#: Names that operators use for their own columns.
CLASH = ["sig", "fp", "text_hash", "h", "d", "value", "host", "shard", "score", "kept", "tokens", "topic", "row", "n", "place"]


def docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    common.ship(spark)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, empty):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables: nothing crashes."""
    d = docs(spark).where("1 = 0") if empty else docs(spark)
    n = 0 if empty else len(ODD)
    path = queries.tokenizer_path()
    assert packing.pack(d, path).select("doc_id").distinct().count() == (0 if empty else 6)
    assert packing.sequences(d, path).agg(F.sum("n_tokens")).first()[0] == packing.pack(d, path).agg(F.sum("length")).first()[0]
    assert langid.identify(d).count() == n
    assert pii.report(d).count() == n
    assert pii.redacted(d).count() == n and pii.redacted(d).columns == d.columns
    assert ngram_join.linked(d).count() == n
    assert quality.judged(d).count() == n
    assert mixing.mixed(d).count() == n
    assert licences.scanned(d).count() == n


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_the_tightest(seed):
    rng, window = np.random.default_rng(seed), 64
    lengths = sorted(rng.integers(1, 64, 300).tolist(), reverse=True)
    free: list[int] = []
    where, offset, fill = packing.best_fit(lengths, window)
    for n, w in zip(lengths, where):
        fits = [f for f in free if f >= n]
        if not fits:
            assert w == len(free)
            free.append(window)
        else:
            assert free[w] == min(fits)
        free[w] -= n
    assert fill == [window - f for f in free]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    d = common.table(spark, SF, "documents")
    got = packing.pack(d, queries.tokenizer_path(), pool_tokens=20_000).toPandas()
    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    for doc, text in d.select("doc_id", "text").collect():
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in got[got.doc_id == doc].sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in fill)
    assert padding < 0.03 * fill.sum()
    out = packing.sequences(d, queries.tokenizer_path(), pool_tokens=20_000).toPandas()
    assert out.n_tokens.sum() == fill.sum()


def test_token_memory_equals_tokenizer():
    from tokenizers import Tokenizer

    from hirelake.llm.tokens import TokenBytes

    path = queries.tokenizer_path()
    ours, ref = TokenBytes(path, chunks=50, words=50), Tokenizer.from_file(path)
    for t in ["", "It's A Test, isn't it?", "É́a é x y z", "<|endoftext|> a<|startoftext|>b", "a\x1cb", "İstanbul ΣΑΣ 日本語 12ab", "naïve—word… \t\n x" * 3, "ß ẞ ﬁ"]:
        assert ours(t) == np.array(ref.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_language_held_out_accuracy(spark):
    d = common.table(spark, SF, "documents")
    r = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.97


def test_language_vectors_against_plain_binding():
    """Bound letters, bundled n-grams and cosines by plain loops, for one text at a time."""
    space = langid.Space(64, 3, 5)
    letters = np.random.default_rng(5).integers(0, 2, (langid.ALPHABET, 64), dtype=np.int8) * 2 - 1
    texts = ["Hello, World", "a", "", "12 !", "Größe  \n ßé", "abc abc abc"]
    counts, n_letters = space.counts(texts)
    got = space.bundled(counts, np.float64)
    for text, vector, n in zip(texts, got, n_letters):
        codes = [space._place(ord(c)) for c in f" {text} "]
        codes = [c for k, c in enumerate(codes) if c or not k or codes[k - 1]]
        want = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b or a and c:
                want += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
        assert n == sum(c > 0 for c in codes)
        # Two texts share the blank between them: n-grams around it are counted with one of them.
        alone = langid.Space(64, 3, 5)
        one, _ = alone.counts([text])
        assert np.allclose(alone.bundled(one, np.float64)[0], want) and (n == 0 or np.linalg.norm(vector - want) <= 8 * 2)


def test_pipeline_rejects_what_is_no_language(spark):
    d = common.table(spark, SF, "documents")
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for _ in range(20)]
    foreign = ["Съешь ещё этих мягких французских булок, да выпей чаю", "これは日本語の文章です。とても長い文章。", "το γρήγορο καφέ αλεπού πηδά πάνω από το", "这是一个测试文本。", "12 34 !!", ""]
    planted = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(noise + foreign)], d.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, d.unionByName(planted), SF).select("doc_id").collect()}
    assert len([k for k in kept if k >= 10**6]) <= 1
    clean = {r.doc_id for r in d.where("length(text) >= 40").select("doc_id").collect()}
    assert len(clean - kept) <= 0.005 * len(clean)


def jaccard_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", range(2))
def test_join_against_brute_force(spark, seed):
    """Near copies of all sizes, some around the threshold, a shared passage, copies, tiny texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(50)]
    rows, texts = [], []
    for _ in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 160))))
        texts.append(words + passage if rng.random() < 0.4 else words)
    for k in range(240):
        words = list(texts[int(rng.integers(0, len(texts) if k % 3 else 6))])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 1000)}"
        rows.append((k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, " \t\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    common.ship(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(d).collect()}
    assert got == jaccard_components(rows, 4, 85)


def test_components_of_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 90), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(e).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[90] == 0 and got[201] == 200


def test_base_spans_against_regex():
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "x.y@", "@b.c", "a@b.c_d@e.f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-1234", "+12", "word", " ", "+1((", "00000000000000", "é@é.fr"]

    def luhn(d):
        return sum(v - 9 if (v := int(c) * (1 + k % 2)) > 9 else v for k, c in enumerate(d[::-1])) % 10 == 0

    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", "-", "."]) for _ in range(int(rng.integers(0, 9))))
        want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                want.append((2, *m.span()))
        want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == want, t


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some filler here call me on: +1 (555) 010-{1000 + i} today") for i in range(8)]
    rows += [(100, "please call me on: 555 0101 999 now"), (101, "the order 5550101998 is fine"), (102, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    common.ship(spark)
    got = {r.doc_id: r.spans for r in pii.report(d).collect()}
    assert got[100] == "phone:19:31" and got[101] == "" and got[102] == ""
    assert {r.doc_id: r.text for r in pii.redacted(d).collect()}[100] == "please call me on: <PHONE> now"


def bootstrapped(texts):
    """Spans of each text by plain dictionaries: base spans, and candidates that the rounds accept."""
    plain = lambda w: re.sub("[0-9]", "0", w.lower())
    totals, edges, mentions = {}, {}, []
    for i, text in enumerate(texts):
        words = [plain(w) for w in text.split()]
        for k in range(len(words) - 1):
            for c in [(words[k],)] + ([(words[k - 1], words[k])] if k else []):
                totals[c] = totals.get(c, 0) + 1
        base = pii.base_spans(text)
        near = [c for c in pii.candidate_spans(text) if all(c[2] <= s[1] or s[2] <= c[1] for s in base)]
        for span, known in [(s, True) for s in base] + [(c, False) for c in near]:
            before = [plain(w) for w in text[: span[1]].split()]
            value = (span[0], text[span[1] : span[2]].lower())
            mentions.append((i, span, known, value))
            for c in {tuple(before[-1:]), tuple(before[-2:])} - {()}:
                own = edges.setdefault((c, span[0]), {}).setdefault(value, [False, 0])
                own[0], own[1] = own[0] or known, own[1] + 1
    edges = {p: v for p, v in edges.items() if len(v) >= pii.VALUES}
    first = {v for values in edges.values() for v, (k, _) in values.items() if k}
    known = set(first)
    for _ in range(pii.ROUNDS):
        doubt = {}
        for (c, _), values in edges.items():
            hits = [n for v, (_, n) in values.items() if v in known]
            sure = sum(hits) / max(totals.get(c, 0), sum(n for _, n in values.values()))
            if len(hits) >= pii.VALUES and sure >= pii.PATTERN_SURE:
                for v in values:
                    doubt[v] = doubt.get(v, 1.0) * (1 - min(sure, 0.99))
        known |= {v for v, d in doubt.items() if 1 - d >= pii.INSTANCE_SURE}
    out = [set() for _ in texts]
    for i, span, sure, value in mentions:
        if sure or value in known - first:
            out[i].add(span)
    return out, len(known - first)


@pytest.mark.parametrize("seed", range(2))
def test_bootstrapping_against_dictionaries(spark, seed):
    """Several contexts and kinds, chains that need a second round, and contexts that stay doubtful."""
    rng = np.random.default_rng(seed)
    word = lambda: str(rng.choice([f"w{i}" for i in range(40)]))
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    made = {
        "ring me on": (lambda: "+1 555 " + digits(7), lambda: digits(9)),
        "mail goes to": (lambda: f"{word()}@{word()}.org", lambda: f"{word()} at {word()} dot org"),
        "host answers from": (lambda: f"10.0.{rng.integers(0, 9)}.{rng.integers(0, 250)}", lambda: f"10[.]0[.]{rng.integers(0, 9)}[.]{rng.integers(300, 400)}"),
        "as in": (lambda: "+44 20 " + digits(8), lambda: digits(8)),  # mostly stands before other words
    }
    texts = []
    for context, (sure, near) in made.items():
        texts += [f"{word()} {context} {sure()} {word()}" for _ in range(14)] + [f"{word()} {context} {near()} {word()}" for _ in range(5)]
    shared = [digits(9) for _ in range(9)]
    texts += [f"{word()} ring me on {x}" for x in shared] + [f"{word()} fax number {x} {word()}" for x in shared] + [f"{word()} fax number {digits(9)} {word()}" for _ in range(3)]
    texts += [f"{word()} as in {word()} {word()}" for _ in range(60)] + ["", f"{digits(9)}", f"at {digits(8)} {'long' * 100} {digits(9)}"]
    texts = [texts[k] for k in rng.permutation(len(texts))]
    want, added = bootstrapped(texts)
    assert added >= 10
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    common.ship(spark)
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.find(d).collect()}
    assert got == dict(enumerate(want))


def test_quality_against_sql(spark):
    from checking import duck, same

    same(queries.op9_quality(spark, SF), duck(SF), queries.OP9_SQL)


def test_warc_against_sql_and_members(spark):
    from checking import duck, same

    same(queries.op10_warc(spark, SF), duck(SF), queries.OP10_SQL)
    rows = [(1, "http://a/", "x" * 1200), (2, None, "x" * 1200), (3, "http://b\r\n/", None), (4, "u", "é" * 600), (5, "u", "short"), (6, "u", "short"), (6, "u", "short")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("d", F.lit(1)).withColumn("n", F.lit(2))
    common.ship(spark)
    index, folder = warc.archived(d, per_file=2)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_back(index).collect())
    assert got == [(1, 1200, "revisit", 2), (2, 1200, "response", None), (3, 0, "response", None), (4, 1200, "response", None), (5, 5, "response", None), (6, 5, "response", None), (6, 5, "response", None)]
    row = index.where("page_id = 4").first()
    with open(row.archive.removeprefix("file://"), "rb") as f:
        f.seek(row.offset)
        assert "é".encode() * 600 in gzip.decompress(f.read(row.length))
    empty, _ = warc.archived(d.where("1 = 0"))
    assert warc.read_back(empty).count() == 0


def test_pages(spark):
    page = lambda k, body: f"<html><head><title>t{k}</title></head><body><header>Site</header><nav><a>Home {k}</a></nav>{body}<div class='promo'>Buy {k}</div><div class=x>Same on all</div><footer>f</footer></body></html>"
    rows = [(k, "http://h.example/%d" % k, page(k, f"<article><h1>T{k}</h1><p>One <b>bo</b>ld &amp; two{k}<br>three<p>Next &lt;x&gt; {k}<ul class='comments'><li>no</ul></article>")) for k in range(8)]
    rows += [(50 + k, "http://g.example/%d" % k, page(k, f"<p>Free text {k} here</p>")) for k in range(8)]
    rows += [(100, None, None), (101, "", ""), (102, "x", "<p>cut <b>off <scr"), (103, "x", "<script>" * 50 + "a"), (104, "x", "<div>" * 3000 + "deep")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("constant", F.lit("z"))
    common.ship(spark)
    got = {r.page_id: r.text for r in html_main.extracted(d).collect()}
    assert got[3] == "T3 One bold & two3 three Next <x> 3"
    assert got[53] == "Free text 3 here"  # the constant slot is template
    assert got[100] == "" and got[101] == "" and got[102].startswith("cut off") and got[104] == "deep"
    assert html_main.extracted(d.where("1 = 0")).count() == 0


def test_boilerplate_within_articles(spark):
    page = lambda body: f"<html><body><article><h1>Daily note</h1>{body}</article></body></html>"
    notice = "<p>Subscribe to <a>our letter</a> every week.</p>"
    rows = [(k, f"http://a.example/{k}", page(f"<p>first {k}</p><p>Well, <b>then</b> {k % 3}</p>{notice}<div>All texts may be <i>passed</i> on.</div>")) for k in range(12)]
    # Too few pages; an article that is the same on all pages, which differ outside it.
    rows += [(20 + k, f"http://b.example/{k}", page(f"<p>first {k}</p>{notice}")) for k in range(6)]
    rows += [(40 + k, f"http://c.example/{k}", page("<p>The only text.</p>") + f"<p>{k}</p>") for k in range(12)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extracted(d).collect()}
    assert all(got[k] == f"Daily note first {k} Well, then {k % 3}" for k in range(12))
    assert all(got[20 + k] == f"Daily note first {k} Subscribe to our letter every week." for k in range(6))
    assert all(got[40 + k] == "Daily note The only text." for k in range(12))


def test_slots_outrank_weak_names(spark):
    """A varying block of a weak name is content where the host has pages enough, and so is not where it hasn't."""
    page = lambda k: f"<article><p>Text {k}</p><div class='related-reading'>More {k}</div><p>Same on all</p><div class=comments>c{k}</div></article>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(50 + k, f"http://b.example/{k}", page(k)) for k in range(3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    common.ship(spark)
    got = {r.page_id: r.text for r in html_main.extracted(d).collect()}
    assert all(got[k] == f"Text {k} More {k}" for k in range(12))
    assert all(got[50 + k] == f"Text {k} Same on all" for k in range(3))
    assert html_main.main_text(html_main.parse(page(3)), frozenset()) != got[3]


@pytest.mark.parametrize("depth", [3, 199, 200, 201, 260, 5000])
def test_depth_changes_nothing(depth):
    html = "<div>" * depth + "<nav><ul><li><a>menu</a></li></ul></nav>one<p>two <b>th</b>ree<p>four</p><div class=ad><p>buy</div>five<script>x</script>" + "</div>" * depth + "<p>six</p>"
    assert html_main.main_text(html_main.parse(html), frozenset()) == "one two three four five six"
    html = "<div>" * depth + "out<article><p>in</p><aside><p>no</p></aside><article>more</article></article>" + "</div>" * depth
    assert html_main.main_text(html_main.parse(html), frozenset()) == "in more"


@pytest.mark.parametrize("seed", range(3))
def test_tree_matching_against_brute_force(seed):
    rng = np.random.default_rng(seed)

    def tree(depth):
        return [(str(rng.choice(list("abc"))), tree(depth - 1)) for _ in range(int(rng.integers(0, 4)) if depth else 0)]

    def text(nodes):
        return " ".join(f"{n}({text(c)})" for n, c in nodes)

    def best(a, b):  # the largest matching of two forests, first trees matched or one of them left out
        if not a or not b:
            return 0
        both = 1 + best(a[0][1], b[0][1]) + best(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
        return max(both, best(a[1:], b), best(a, b[1:]))

    def parents(nodes, parent, out):
        for _, children in nodes:
            own = len(out)
            out.append(parent)
            parents(children, own, out)
        return out

    for _ in range(150):
        x, y = tree(3), tree(3)
        got = html_main.aligned(text(x), text(y))
        assert len(got) == best(x, y) and len(set(got.values())) == len(got)
        above, below = parents(x, -1, []), parents(y, -1, [])
        assert all(got.get(above[p], -1) == below[q] for p, q in got.items())
        assert all((p < q) == (got[p] < got[q]) for p in got for q in got if p != q)


def test_tree_matching_is_the_largest():
    a, b = "html(body(p() div() p()))", "html(body(div() p(b()) ul()))"
    assert html_main.aligned(a, b) == {0: 0, 1: 1, 3: 2, 4: 3}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    rows = [(int(i), [float(x) for x in base[i % 12] + 0.4 * rng.normal(size=16)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 16) for i in range(60)]  # copies
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [1.0] * 3), (None, [1.0] * 16), (20, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("point", "n", "query", "rank")})
    common.ship(spark)
    got = ann.nearest(d, F.col("vec_id") % 20 == 0).toPandas()
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 2000 and v is not None]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 9)))[:20]]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and list(mine["rank"]) == list(range(1, 21)) and q not in set(mine.vec_id)
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 20
    assert hit / total >= 0.95
    assert ann.nearest(d.where("1 = 0"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(d.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_of_a_full_shard(spread):
    """20,000 points in one graph, of one length and of lengths that vary, against all inner products."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 64))
    v *= np.exp(rng.normal(size=(20_000, 1)) * spread) / np.linalg.norm(v, axis=1, keepdims=True)
    levels = ann._levels(np.arange(20_000), ann.LINKS)
    v = v[np.argsort(-levels, kind="stable")]
    graph = ann.Graph.build(v.astype(np.float32), -np.sort(-levels))
    asked = rng.choice(20_000, 100, replace=False)
    places, _ = graph.search(v[asked].astype(np.float32), ann.NEAREST)
    best = np.argsort(-(v[asked] @ v.T), axis=1)[:, : ann.NEAREST]
    assert np.mean([len(set(a) & set(b)) / ann.NEAREST for a, b in zip(places, best)]) >= 0.9


def test_mixing_reaches_its_targets(spark):
    d = common.table(spark, SF, "documents")
    cells = mixing.probabilities(mixing._keyed(d, "doc_id", "text", None, None))
    rows = cells.toPandas()
    for m, power in mixing.TEMPERATURE.items():
        natural = rows.groupby(m).tokens.sum() ** power
        got = rows.groupby(m).weight.sum()
        assert np.abs(got / (natural / natural.sum()) - 1).max() < 0.02
    # Against iterative fitting in numpy.
    w = rows.tokens.to_numpy(float)
    for _ in range(200):
        for m, power in mixing.TEMPERATURE.items():
            t = rows.groupby(m).tokens.sum() ** power
            w = w * rows[m].map(t / t.sum()).to_numpy() / rows[m].map(rows.assign(w=w).groupby(m).w.sum()).to_numpy()
    assert np.abs(rows.weight / w - 1).max() < 0.05
    assert abs((rows.probability * rows.tokens).sum() / rows.tokens.sum() - mixing.BUDGET) < 0.01
    mixed = mixing.mixed(d).toPandas()
    assert sorted(r.doc_id for r in mixing.kept(d).collect()) == sorted(mixed[mixed.kept].doc_id)


@pytest.mark.parametrize("seed", range(3))
def test_calibration_against_water_filling(spark, seed):
    """Rates a factor of 10**9 apart, zero weights, and empty cells, against the exact solution on sorted rates."""
    rng = np.random.default_rng(seed)
    rows = [(f"s{k}", int(rng.integers(0, 4) and rng.integers(1, 10**6)), float(rng.choice([0.0, 10 ** rng.uniform(-9, 0)]))) for k in range(40)] + [("x", 1_000_000, 1.0), ("y", 1_000_000, 1e-9)]
    cells = spark.createDataFrame(rows, "source string, tokens long, weight double")
    got = mixing.calibrated(cells, 0.3).toPandas()
    t, w = got.tokens.to_numpy(float), got.weight.to_numpy()
    assert (got.probability[t == 0] == 1).all() and (got.probability[(t > 0) & (w == 0)] == 0).all()
    goal, some = 0.3 * t.sum(), (t > 0) & (w > 0)
    t, w, p = t[some], w[some], got.probability.to_numpy()[some]
    want = np.ones(len(t))
    if t.sum() > goal:
        order = np.argsort(-(w / t))
        for k in range(len(order) + 1):  # the first k are full
            rest = order[k:]
            c = (goal - t[order[:k]].sum()) / w[rest].sum() if len(rest) else np.inf
            if c >= 0 and (c * w[rest] / t[rest] <= 1 + 1e-12).all():
                want = np.minimum(1, c * w / t)
                break
        assert abs((p * t).sum() / goal - 1) < 1e-5
    assert np.allclose(p, want, rtol=1e-4)


def test_mixing_to_stated_targets(spark):
    rows = [(k, "word " * (3000 if s == "big" else 1), lang, s) for k, (s, lang) in enumerate([("big", "en")] * 20 + [("small", "en")] * 20 + [("small", "de"), (None, "de"), ("gone", "en")])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    common.ship(spark)
    got = mixing.mixed(d, wanted={"source": {"big": 0.5, "small": 0.25, "gone": 0.0}}, temperature={"source": 1.0}, budget=0.0005).toPandas()
    cell = got.assign(e=got.probability * got.tokens).groupby("source", dropna=False).e.sum()
    assert cell["gone"] == 0 and abs(cell["big"] / cell["small"] - 2) < 1e-3 and (got.probability[got.source.isna()] > 0).all()
    flat = mixing.mixed(d, temperature={"source": 2.0, "lang": 2.0, "topic": 2.0}).toPandas()
    assert flat.probability.max() > 0 and abs((flat.probability * flat.tokens).sum() / flat.tokens.sum() - mixing.BUDGET) < 0.01
    with pytest.raises(ValueError):
        mixing.mixed(d, wanted={"source": {"big": 0.9, "small": 0.9}})
    # No weights can give source a all and language y half: a has no y.
    odd = spark.createDataFrame([(1, "w w", "x", "a"), (2, "w w", "y", "b")], "doc_id long, text string, lang string, source string")
    assert mixing.mixed(odd, wanted={"source": {"a": 1.0}, "lang": {"y": 0.5}}).count() == 2


FILLER = [(100 + i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(20))) for i in range(60)]


@pytest.fixture(scope="module")
def scanner(spark):
    return licences.train(spark, common.table(spark, SF, "documents"))


def test_licences(spark, scanner):
    rows = [(1, "Some text.\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "nothing to see here at all"), (4, "Subject to the Zebra licence of 1893."), (5, None), (None, "All rights reserved.")]
    d = spark.createDataFrame(rows + FILLER, "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scanned(d).collect()}
    assert got[1] == ["mit"] and got[2] == ["apache-2.0"] and got[3] == [] and got[4] == ["unknown"] and got[5] == [] and got[None] == ["proprietary"]
    assert licences.scanned(d.where("1 = 0")).count() == 0
    assert licences.train(spark, d.where("1 = 0")).least_family >= 0.5


def test_wrapped_licences(spark, scanner):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3"
    prose = "w1 w2 w3 w4\nw5 w6 to any of the w7"
    texts = {
        1: f"{prose}\n{grant}\n{prose}",
        2: f"{prose}\n\n{bsd}\n\n{prose}",
        3: f"{gpl}\n{prose}",
        4: "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
        5: "w1 w2 All rights\nreserved.",
        7: f"Released under the MIT License.\n{bsd}\nLicensed under the Apache License, Version 2.0.",
        8: prose,
    }
    d = spark.createDataFrame([*texts.items(), *FILLER], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_licence_lines, r.n_confirmed) for r in licences.scanned(d, scanner).collect() if r.doc_id < 100}
    assert got[1] == (["mit"], 3, 3) and got[2] == (["bsd"], 3, 3) and got[3] == (["gpl"], 3, 3)
    assert got[4] == (["cc-by-nc"], 2, 2) and got[5] == (["proprietary"], 2, 2)
    assert got[7] == (["apache-2.0", "bsd", "mit"], 5, 5) and got[8] == ([], 0, 0)
    lines = [(r.first_line, r.last_line, r.family) for r in licences.paragraphs(d.where("doc_id = 1"), scanner).collect()]
    assert lines == [(2, 4, "mit")]


def found(scanner, text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return [(a, b, family) for _, a, b, family, _, _ in scanner.scan(raw, np.array([len(raw)]))]


def test_neighbouring_notices_lose_no_line(scanner):
    """k template lines in any order and without blank lines between give k lines, in linear time."""
    short = [(f, x) for f, ts in licences.TEMPLATES.items() for x in ts if len(x) < 90]
    draw = random.Random(5)
    for k in (2, 3, 7, 40, 2000):
        lines = [draw.choice(short) for _ in range(k)]
        began = time.time()
        got = found(scanner, "\n".join(x for _, x in lines))
        assert time.time() - began < 10
        assert {n for a, b, _ in got for n in range(a, b + 1)} == set(range(k))
        named = {n: f for a, b, f in got for n in range(a, b + 1)}
        assert sum(named[n] == f for n, (f, _) in enumerate(lines)) >= 0.95 * k
    assert found(scanner, "Licensed under the MIT license.\nLicensed under CC BY 4.0.") == [(0, 0, "mit"), (1, 1, "cc-by")]
    assert found(scanner, "\n".join(["Released under the MIT License."] * 10)) == [(k, k, "mit") for k in range(10)]
    three = ["Licensed under the MIT license.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0."]
    assert [f for _, _, f in found(scanner, "\n".join(three * 200))] == ["mit", "cc-by", "apache-2.0"] * 200


def test_best_partition_of_sentences(scanner):
    """The pass over the sentences finds what trying every partition finds."""
    draw = np.random.default_rng(3)
    own = licences.Scanner(np.zeros(0, dtype=np.uint64), np.zeros((0, len(licences.LABELS))), np.where(np.arange(len(licences.LABELS)) == 0, 0.0, -1.5))

    def worth(gain, cut):
        return sum(gain[a : b + 1].sum(axis=0).max() - 1.5 - licences.JOINED * (b - a) for a, b in cut)

    def partitions(a, n):
        yield []
        for x in range(a, n):
            for y in range(x, n):
                for rest in partitions(y + 1, n):
                    yield [(x, y), *rest]

    for _ in range(20):
        sums = draw.normal(0, 3, (5, len(licences.LABELS)))
        sums[:, 0] = sums[:, 1:].max(axis=1) - draw.uniform(0.5, 5, 5)
        gain = sums[:, 1:] - sums[:, :1]
        top = gain.max(axis=1, keepdims=True)
        gain = np.where((top > licences.JOINED) & (gain > 0) & (gain < licences.APART * top), -np.inf, gain)
        best = max(worth(gain, cut) for cut in partitions(0, 5))
        assert worth(gain, own.stretches(sums)) == pytest.approx(best)


def test_held_out_examples(scanner):
    n, precision, recall = (np.array(x) for x in zip(*[v for k, v in scanner.held_out.items() if k not in (licences.NONE, licences.UNKNOWN)]))
    assert n.min() >= 5 and (precision * n).sum() / n.sum() > 0.95 and (recall * n).sum() / n.sum() > 0.8
    assert scanner.held_out[licences.NONE][1] > 0.9 and scanner.held_out[licences.NONE][2] > 0.99


def test_headings_and_abbreviations(scanner):
    families = lambda text: [f for _, _, f in found(scanner, text)]
    assert families("MIT License") == ["mit"] and families("Licensed under GPLv3") == ["gpl"]
    assert families("distributed under the terms of the Apache License 2.0") == ["apache-2.0"]
    assert families("The code is available under GPL version 3.") == ["gpl"]
    assert families("The general public came to the library.") == []


def test_the_classifier_decides(scanner):
    """Results that neither templates nor words of licences alone would give."""

    def families(own, text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return [x[3] for x in own.scan(raw, np.array([len(raw)]))]

    assert families(scanner, "You may copy and share this text under the terms of the Aurora agreement.") == ["unknown"]  # no template is near
    assert families(scanner, "The driving licence office opens at nine.") == []  # a word of licences, another sense
    hashes, weights, *rest = scanner.parts()
    blind = licences.Scanner(hashes, np.zeros_like(weights), *rest)
    assert families(scanner, "Released under the MIT License.") == ["mit"] and families(blind, "Released under the MIT License.") == []


def test_sentence_scores_against_dictionaries(scanner):
    """The vectorised n-grams and the exact bound against sums over plain word lists."""
    place = {int(h): k for k, h in enumerate(scanner.known.hashes)}
    rng = np.random.default_rng(5)
    words = [w for ts in licences.TEMPLATES.values() for t in ts for w in t.split()] + [f"w{i}" for i in range(50)]
    texts = ["", "\n", *[" ".join(rng.choice(words, int(rng.integers(1, 30)))) + rng.choice([".", "\n\n", "\nx y", ""]) for _ in range(60)]]
    grams = licences.Grams.of(texts)
    chosen, sums = scanner.evidence(grams)
    single = {}
    for t in texts:
        for w in re.findall("[A-Za-z0-9]+", t):
            single[w.lower()] = int(licences.Grams.of([w]).hashes[0])
    at = 0
    for i, text in enumerate(texts):
        previous = None
        for line in text.split("\n"):
            found = [x for x in (re.findall("[A-Za-z0-9]+", s) for s in re.split("(?<=[.!?]) ", line)) if x]
            if not line.strip():
                previous = None
            for own in found:
                assert grams.text[at] == i
                keys = {single[w.lower()] for w in own}
                run = ([previous] if previous else []) + [w.lower() for w in own]
                keys |= {int(licences.mixed(np.array([single[a]], dtype=np.uint64) * licences._PAIR + np.uint64(single[b]))[0]) for a, b in zip(run, run[1:])}
                want = sum((scanner.weights[place[k]].astype(float) for k in keys if k in place), np.zeros(len(licences.LABELS)))
                if at in chosen:
                    assert np.allclose(sums[list(chosen).index(at)], want, atol=1e-3)
                else:
                    assert (want + scanner.bias).argmax() == 0
                previous, at = run[-1], at + 1
    assert at == len(grams)


def test_near_duplicates_of_rows(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [
        (None, text(1)), (None, text(2)), (None, text(3) + " end"), (3, text(3)),  # null ids; a copy with an id comes first
        (5, text(5)), (5, text(6)), (5, text(7) + " end"), (4, text(7)),  # one id, several texts; one of them a copy
        (8, text(8)), (8, text(8)),  # repeated rows
        (None, text(9)), (None, text(9)), (None, text(9) + " end"),  # only null ids in a group
        (11, ""), (11, ""), (None, None), (None, None),
    ]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, d, SF)
    assert out.columns == d.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    ninth = [x for x in got if (x[1] or "").startswith("t9")]
    assert len(ninth) == 1 and ninth[0] in rows
    want = [rows[k] for k in (0, 1, 3, 4, 5, 7, 8, 13, 14, 15, 16)]
    assert sorted(map(str, (x for x in got if x not in ninth))) == sorted(map(str, want))


def test_links_through_rows_without_id(spark):
    part = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    d = spark.createDataFrame([(1, part(0, 94)), (None, part(0, 100)), (2, part(6, 106))], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.linked(d).collect()} == {1}


def test_overlapping_spans_leave_nothing(spark):
    d = spark.createDataFrame([(1, "write to 1.2.3.4@mail.example.com today"), (None, "or 10.20.30.40@a.example.org")], "doc_id long, text string")
    common.ship(spark)
    assert sorted(r.text for r in pii.redacted(d).collect()) == ["or <EMAIL>", "write to <EMAIL> today"]


def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    d = common.table(spark, SF, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = (d, common.saved(stage(spark, d, SF), "test-stage"))
        d = after[name][1]
    columns = common.table(spark, SF, "documents").columns
    assert all(out.columns == columns for name, (_, out) in after.items() if name != "packing")
    before, out = after["near_duplicates"]
    want = jaccard_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, root) in want.items() if i == root)
    before, out = after["personal_data"]
    assert before.count() == out.count()
    assert not [r.doc_id for r in out.collect() if pii.base_spans(r.text)]
    before, out = after["packing"]
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in before.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == out.agg(F.sum("length")).first()[0]
