"""Each operator against a brute-force version on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from ebbflow.llm import bytebpe, covertree, html, jaccard, langid, lbl, packing, quality, secrets, substrings, suffixes
from ebbflow.llm.common import is_remainder
from ebbflow.llm.vocab import public_path, ranks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE_TEXTS = ["", "a", "a b", "x\n\nx\nx", "  a", " \t", "one two three four five six seven eight " * 3, "É́a\nß|#"]


# ------------------------------------------------------------------ 1 quality rules
def quality_base(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked.update(range(i, i + 8))
    n, r = len(words), len(marked)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, n < 20 or 100 * r > 30 * n


def test_quality_base(spark, doc_rows):
    rows = [(r.doc_id, r.text) for r in doc_rows] + [(1000 + k, t) for k, t in enumerate(EDGE_TEXTS)]
    got = quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    text = dict(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_base(text[r.doc_id])
        assert not (r.kept and r.base_failed)
        kept_lines = r.clean_text.split("\n")
        assert len(WORD.findall(r.clean_text)) == r.n_words_kept
        assert set(kept_lines) <= set(text[r.doc_id].split("\n")) | {""}


@pytest.mark.parametrize("line, stays", [
    ("A proper sentence of some words, which ends as it should.", True),
    ("Home | News | Sport | Contact", False),
    ("All rights reserved.", False),
    ("this line has no end and no stop and it just goes on", False),
    ("buy### now*** cheap$$$ pills%%% here&&& today###", False),
    ("again again again again again again again.", False),
    ("“A quotation ends with its own mark.”", True),
])
def test_quality_lines(spark, line, stays):
    other = "This is a long and harmless sentence that stays in place, whatever happens to the others.\n" * 1
    got = quality.line_quality(spark.createDataFrame([(1, other + line)], "doc_id long, text string"), with_text=True).first()
    assert (line in got.clean_text) == stays


def test_quality_verdicts_agree_with_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.line_quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert rows and all(r.kept == bool(r.quality) for r in rows)


# ------------------------------------------------------------------ 2 html
PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header><h1>Site</h1></header><!-- <p>gone</p> -->
<div class="ad">Buy</div><article><header><h1>Head &amp; tail</h1></header><p>One <b>bo</b>ld&nbsp;&eacute;&#x41;
  line<br>two<p>Unclosed <a href='a>b'>link</a>.<div class="cookie-banner">We use cookies</div>
<ul><li>First</li><li>Second</ul><form><p>Sign</p></form><p>5 < 6 &lt;b&gt;</p>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></article>
<aside><p>Side</p></aside><footer>&copy; Site</footer></body></html>"""


def test_html_blocks():
    article, loose = html.blocks(PAGE)
    assert article == ["Head & tail", "One bold éA line two", "Unclosed link.", "First", "Second", "5 < 6 <b>"]
    assert loose == []
    assert html.blocks("") == ([], [])
    assert html.blocks("just text") == ([], ["just text"])
    assert html.blocks("<p>a<p>b</div><div hidden>c</div>") == ([], ["a", "b"])


@pytest.mark.parametrize("page, article, loose", [
    ('<p>Text <i aria-hidden="true">x</i> more text</p>', [], ["Text more text"]),
    ('<body><a class="skip-link" href="#m">Skip</a><main><p>Body</p></main></body>', ["Body"], []),
    ('<p>Before <span class="ad">Buy <span>now</span> here</span> after</p>', [], ["Before after"]),
    ('<article><p>One <img class="social" src="x"> two<p>Three <b id="share">x<p>four</article>', ["One two", "Three", "four"], []),
    ('<div>a <span hidden>b<div>c</div>d</span> e</div>f', [], ["a", "e", "f"]),
    ('<a class="skip-link" href="#m"><p>Skip</a><main><p>Body</main>', ["Body"], []),
    ('<p>a<i class="ad">b</p><p>c</i> d</p>', [], ["a", "c d"]),
])
def test_html_inline_chrome(page, article, loose):
    assert html.blocks(page) == (article, loose)


@pytest.mark.parametrize("hot", [4096, 1])
def test_html_host_search(spark, hot):
    def words(tag, n):
        return " ".join(f"{tag}{k}" for k in range(n))
    boiler, rows = words("b", 30), []
    for i in range(8):
        own = words(f"u{i}x", 25)
        rows.append((i, f"http://h.org/{i}", f"<div><p>{boiler}</p><p>{own}</p><p>{words('b', 11)} z{i}</p></div>"))
    rows += [(50, "http://o.org/", f"<p>{boiler}</p>"), (51, None, None), (52, "http://h.org/p", f"<article><p>{boiler}</p></article>")]
    rows += [(53, "http://o.org/2", f"<p>{words('s', 20)}</p><p>{words('s', 20)}</p>")]  # repeats inside one page only
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.main_text(df, html.HostRules(hot_pieces=hot)).collect()}
    for i in range(8):
        assert got[i].text == words(f"u{i}x", 25) + "\n\n" + words("b", 11) + f" z{i}"  # eleven tokens are too few
        assert got[i].n_chars == len(got[i].text)
    assert got[50].text == boiler and got[52].text == boiler and got[51].text == ""
    assert got[53].text == words("s", 20) + "\n\n" + words("s", 20)


def test_html_article_boilerplate(spark):
    """A notice in most articles of a host goes, a paragraph of two articles stays, copies of one page are one article."""
    def words(tag, n):
        return " ".join(f"{tag}{k}" for k in range(n))
    notice, shared, rows = words("n", 20), words("s", 20), []
    for i in range(8):
        own = f"<p>{words(f'u{i}x', 25)}</p>" + (f"<p>{shared}</p>" if i < 2 else "") + (f"<p>{notice}</p>" if i != 7 else "")
        rows.append((i, f"http://h.org/{i}", f"<article>{own}</article>"))
    rows += [(20 + i, f"http://copies.org/{i}", f"<main><p>{words('c', 40)}</p></main>") for i in range(5)]
    rows += [(30 + i, f"http://near.org/{i}", f"<main><p>{words('c', 40)} {i}</p></main>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_tokens_removed) for r in html.main_text(df).collect()}
    for i in range(8):
        assert got[i] == (words(f"u{i}x", 25) + ("\n\n" + shared if i < 2 else ""), 20 if i != 7 else 0)
    assert all(got[20 + i] == (words("c", 40), 0) and got[30 + i] == (words("c", 40) + f" {i}", 0) for i in range(5))


def test_html_open_main_text(spark):
    """A body in a plain div beside teasers or an empty main is the text; a short open line beside an article is not."""
    def words(tag, n):
        return " ".join(f"{tag}{k}" for k in range(n))
    body = words("b", 60)
    pages = [f"<div><p>{body}</p></div><article><p>{words('t', 9)}</p></article><article><p>{words('v', 9)}</p></article>",
             f"<main></main><div><p>{words('c', 60)}</p></div>",
             f"<div>{words('d', 9)}</div><article><p>{words('e', 40)}</p></article>",
             f"<article><p>{words('f', 40)}</p></article><div>{words('g', 50)}</div>"]
    df = spark.createDataFrame([(k, f"http://h.org/{k}", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == {0: body, 1: words("c", 60), 2: words("e", 40), 3: words("f", 40) + "\n\n" + words("g", 50)}


def test_html_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html.main_text(pages).collect()
    assert len(got) == pages.count()
    assert all(r.text and "<" not in r.text.replace("< ", "") for r in got)


# ------------------------------------------------------------------ 3 language model
def tokens(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


@pytest.mark.parametrize("head", [262_144, 500])
def test_lm_scores(docs, doc_rows, head):
    rules = lbl.LblRules(n_words=200, n_rare=13, n_head=head, steps=40, flush_words=1000)
    got = lbl.score(docs, is_remainder("doc_id", 7, 2), rules).collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in doc_rows}
    count = Counter(t for r in doc_rows if not held[r.doc_id] for t in tokens(r.text))
    total, distinct = sum(count.values()), len(count)
    text = {r.doc_id: r.text for r in doc_rows}
    for r in got:
        t = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(count[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t), rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # beats the base on unseen texts


def test_lm_is_normalised():
    rules = lbl.LblRules(n_words=40, n_rare=5, steps=30)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (rules.classes, rules.classes))
    table = lbl.train(counts, rules).log10_table()
    assert np.allclose((10.0 ** table).sum(axis=1), 1, atol=1e-4)
    # the trained transition probabilities follow the counts
    share = counts / counts.sum(axis=1, keepdims=True)
    assert np.corrcoef((10.0 ** table).ravel(), share.ravel())[0, 1] > 0.3


# ------------------------------------------------------------------ 4 secrets
def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, docs, doc_rows):
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ": ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", " ", "é", "x9Kq#2mLp!8v", "pwd"]
    made = [(10_000 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(300)]
    rows = [(r.doc_id, r.text) for r in doc_rows] + made
    text = dict(rows)
    for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = base_spans(text[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("guess")] == [x for x in joined.split(",") if x]


def brute_cost(value):
    """The same segment costs, every cut tried."""
    from functools import lru_cache
    pools = 0
    for c in value:
        pools |= 1 << secrets._pool(c)
    per, low, plain = secrets._POOL_BITS[pools], value.lower(), value.lower().translate(secrets._LEET)

    def segment(i, j):
        n, cost = j - i, math.inf
        if n >= 3 and low[i:j] in secrets._RANK:
            cost = min(cost, secrets._RANK[low[i:j]] + 0.3)
        elif n >= 3 and plain[i:j] in secrets._RANK:
            cost = min(cost, secrets._RANK[plain[i:j]] + 0.8)
        m = secrets._DATE.match(value, i)
        if m and m.end() == j:
            cost = min(cost, 4.6)
        if n >= 3 and all((low[k - 1], low[k]) in secrets._NEXT for k in range(i + 1, j)):
            cost = min(cost, 2.2 + math.log10(n))
        for unit in (1, 2, 3, 4):
            if n >= 2 * unit and n >= 3 and all(value[k] == value[k - unit] for k in range(i + unit, j)):
                cost = min(cost, unit * per + math.log10(n))
        return cost

    @lru_cache(None)
    def best(i):
        if i == len(value):
            return 0.0
        out = per + best(i + 1)
        for j in range(i + 1, len(value) + 1):
            out = min(out, (0.3 if i else 0.0) + segment(i, j) + best(j))
        return out

    return best(0)


def test_guess_cost():
    rng = random.Random(5)
    parts = ["password", "dragon", "1234", "2021-03-04", "qwert", "aaaa", "x", "Z", "#", "9", "abab", "p@ssw0rd"]
    for _ in range(200):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))[:26]
        assert secrets.guess_cost(value) == pytest.approx(brute_cost(value))
    assert secrets.guess_cost("password123") < 6 < 12 < secrets.guess_cost("8f3k2j5h9d7s")


def test_guess_spans_and_redaction():
    text = 'the passphrase is "vT7#kQ9!pL2z" and pwd: dragon1234, password=ed4186779a4aeb1eeb.'
    spans = secrets.scan(text)
    assert [text[s:e] for s, k, e in spans if k == 3] == ["vT7#kQ9!pL2z"]
    clean = secrets.redact(text, spans)
    assert "vT7#" not in clean and "ed4186" not in clean and "dragon1234" in clean and clean.startswith("the passphrase")


@pytest.mark.parametrize("text, value", [
    ("pwd: QhZrTkWpLmXvBn", "QhZrTkWpLmXvBn"),
    ("Authorization: Bearer QhZrTkWpLmXvBnYc", "QhZrTkWpLmXvBnYc"),
    ('passphrase: "correct horse battery staple"', "correct horse battery staple"),
    ('pwd: "aB3$kQ9!x,Lm7#Tz"', "aB3$kQ9!x,Lm7#Tz"),
    ("'pwd' => 'aB3$\"kQ9!x,Lm7#Tz'", 'aB3$"kQ9!x,Lm7#Tz'),
    ("pwd\t=\t\n            vT7#kQ9!pL2z.", "vT7#kQ9!pL2z"),
    ("the passcode\n is\u00a0vT7#kQ9!pL2z", "vT7#kQ9!pL2z"),
    ('pwd: "vT7#kQ9!pL2z', "vT7#kQ9!pL2z"),              # no closing quote
    ("secret: extraordinary", None), ("token: authentication", None), ("the password is unforgettable", None),
    ('"password": "Please enter your password"', None), ("secrets: internationalization", None),
])
def test_guess_values(text, value):
    assert [text[s:e] for s, k, e in secrets.scan(text) if k == 3] == ([value] if value else [])
    assert value is None or value not in secrets.redact(text, secrets.scan(text))


# ------------------------------------------------------------------ 5 language ID
def test_language_held_out(docs):
    held = is_remainder("doc_id", 4, 2)
    got = langid.predict(docs, langid.fit(docs.filter(~held)), held).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in got if r.held_out and len(r.text) > 200]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_codes():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.code_matrix(n, langid.CodeRules()).astype(int)
        assert len({tuple(c) for c in code}) == n and all(len(set(code[:, b])) == 2 for b in range(code.shape[1]))
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert n == 2 or apart >= 2  # a bit may err


def test_language_without_letters_or_labels(spark):
    df = spark.createDataFrame([(1, "123", "en"), (2, None, "en"), (3, "Ça va", None)], "doc_id long, text string, lang string")
    held = is_remainder("doc_id", 4, 2)
    none = langid.predict(df, langid.fit(df.filter("lang = 'zz'")), held).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)
    some = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.fit(df.withColumn("lang", df.text.substr(1, 1))), held).collect()}
    assert some[1] == some[2] == "und" and some[3] != "und"


# ------------------------------------------------------------------ 6 packing
def test_packing(spark, docs, doc_rows):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(r.doc_id, r.text) for r in doc_rows] + [(900 + k, t) for k, t in enumerate([*EDGE_TEXTS, "İΣς ﬁ'll Nt, <|endoftext|>", "w " * 9000])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_path("word_bpe_49k.json")).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in rows:
        ids = tk.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(k, s, min(4096, len(ids) - s), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(own[i]) == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    bound = math.ceil(sum(r.length for r in got) / 4096)
    assert bound <= len(sequences) <= bound + 1 + bound // 100


def test_packing_plans():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        lengths, counts = np.unique(rng.integers(1, 4097, n), return_counts=True)
        chosen = packing.plan(lengths, counts)
        assert (sum((t * c for t, c in chosen), np.zeros(len(lengths), int)) == counts).all()
        assert all(0 < c @ lengths <= 4096 and t > 0 for t, c in chosen)
    # 1366 + 2730, twice 2000, three times 1365: the best is 100 + 100 + 67
    lengths, counts = np.array([1365, 1366, 2000, 2730]), np.array([201, 100, 200, 100])
    assert sum(t for t, _ in packing.plan(lengths, counts)) == 267


# ------------------------------------------------------------------ 7 byte BPE
def test_byte_bpe(spark, doc_rows):
    import tiktoken
    path = public_path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    rng = random.Random(6)
    made = ["".join(rng.choice("aab cé日本😀!! \n\t12'sll") for _ in range(rng.randrange(200))) for _ in range(200)]
    made += [*EDGE_TEXTS, "a" * 5000, "ab" * 2000, " " * 300 + "x", "😀" * 200, "<|endoftext|>"]
    rows = [(r.doc_id, r.text) for r in doc_rows] + [(10_000 + k, t) for k, t in enumerate(made)]
    text = dict(rows)
    for r in bytebpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, P.PATTERN, with_ids=True).collect():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


# ------------------------------------------------------------------ 8 suffix arrays
def test_induced_sorting():
    rng = random.Random(7)
    for _ in range(200):
        s = bytes(rng.choice(b"\x02\x03\x05\xf0"[:rng.choice([1, 2, 4])]) for _ in range(rng.randrange(60))) + b"\x00"
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffixes.induced_sort(list(s), 256) == want
        assert suffixes.suffix_array(s).tolist() == want


def cut_brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k:k + length] in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(b[k:k + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("rules", [substrings.RepeatRules(), substrings.RepeatRules(hot_pieces=1, flush_pieces=2000, shard_bytes=3000)])
def test_substring_dedup(spark, doc_rows, rules):
    passage = "A passage that many of the documents hold word for word, and that is well over a hundred bytes long, é."
    rows = [(r.doc_id, r.text) for r in doc_rows] + [(5000 + k, f"{k} own {'x' * (k % 7)}" + passage + f"{k * k} end") for k in range(60)]
    rows += [(6000, "ab" * 300), (6001, "a" * 99), (6002, "a" * 100), (6003, "a" * 350), (6004, ""), (6005, None)]
    want = cut_brute(rows, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for r in substrings.dedup_digest(df, rules).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


# ------------------------------------------------------------------ 9 top-k
@pytest.mark.parametrize("scale, dim", [(1.0, 16), (1e6, 3)])
def test_top_k(spark, scale, dim):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.1, (150, dim)) for c in (0, 1, -1)]) * scale
    x[:40] = x[0]                                    # one very common vector
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(None, [1.0] * dim), (1000, None), (1001, [None] * dim), (1050, [math.nan] * dim), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rules = covertree.TreeRules(block=64, query_block=4, query_chunk=5, leaf=8)
    got = sorted(tuple(r) for r in covertree.top_k(df, df.filter("vec_id % 50 = 0"), rules).collect())
    v = np.array([[int(y) for y in r] for r in np.floor(256 * x)], object)
    want = []
    for q in range(0, len(x), 50):
        s = v @ v[q]
        order = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-int(s[k]), k))[:5]
        want += [(q, n + 1, k, int(s[k])) for n, k in enumerate(order)]
    assert got == sorted(want)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(df, df).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert covertree.top_k(one, one).collect() == []


# ------------------------------------------------------------------ 10 Jaccard join
def jaccard_brute(rows, words=5):
    sets = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        sets[i] = frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    links, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        share = Counter(j for s in sets[i] for j in holders[s])
        for j, n in share.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("rules", [jaccard.JoinRules(), jaccard.JoinRules(bucket_limit=6, block_shingles=2000)])
def test_jaccard(spark, doc_rows, rules):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    family = []
    for k in range(40):                               # near copies, a few words changed in each
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10_000)}"
        family.append((7000 + k, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in doc_rows] + family + [(8000, "a b c"), (8001, "a  b\tc"), (8002, "a b"), (8003, ""), (8004, None)]
    want = jaccard_brute(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rules).collect()
    assert len(got) == len(rows)
    wrong = [(r.doc_id, r.class_id, r.n_links, want[r.doc_id]) for r in got if (r.class_id, r.n_links) != want[r.doc_id]]
    assert not wrong


def test_jaccard_runs():
    assert jaccard.JoinRules().runs == 6
    assert jaccard.JoinRules(target_recall=0.9).runs < 6


def test_jaccard_runs_of_split_buckets():
    """Paths of ``max_level`` picks, which replace those of a split bucket, keep the target as well."""
    rules, p = jaccard.JoinRules(), 1.0
    for _ in range(rules.max_level):
        p = 1 - math.exp(-rules.similarity * rules.width * p)
    assert 1 - (1 - p) ** len(jaccard.run_seeds(rules)) >= rules.target_recall


def test_components(spark):
    from ebbflow.llm.components import components
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 102), (7, 7), (200, 205), (205, 201)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    root = {r.node: r.root for r in rows if r.node != r.root}
    assert root == {**{k: 0 for k in range(1, 31)}, 101: 100, 102: 100, 205: 200, 201: 200}
