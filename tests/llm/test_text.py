"""Kernels, tokens and page text."""

import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plyspark.llm import token_counts as tc
from plyspark.llm import textkernel, tokens
from plyspark.llm.crc32c import _plain, crc32c_many, masked
from plyspark.llm.html_text import extract_text, html_to_text
from plyspark.llm.textkernel import slices
from plyspark.llm.token_records import read_records_at, read_token_records, token_records, write_token_records
from plyspark.llm.token_counts import token_counts
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "Hello, world!", "don't we're İstanbul ΣΑΣ áb", "<|endoftext|> x<|startoftext|>y", "a\x01b \x1c\xa0c　d", "日本語 テスト naïve!!! x1234", "word " * 3000, "x" * 3000, "é" * 600 + "'s", "\t\n a \x0b b\x0c\r"]
text = st.text(alphabet=st.sampled_from(list("abTHE é'sdlß<|>.,!?1 \t\n\x0b\x01\xa0日ΣİKő́")), max_size=60)


@given(st.lists(text, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts):
    seen = []
    for _, _, words in slices(pa.array(texts, pa.string()), 40):
        data = words.data.tobytes()
        hashes = words.hashes()
        for i in range(len(words.counts)):
            own = range(words.first[i], words.first[i + 1])
            seen.append([(data[words.starts[k] : words.ends[k]], int(hashes[k])) for k in own])
    assert [[w for w, _ in ws] for ws in seen] == [t.encode().split() for t in texts]
    pairs = {p for ws in seen for p in ws}
    assert len({w for w, _ in pairs}) == len(pairs) == len({h for _, h in pairs})


@given(st.lists(text, min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_library(texts):
    encoder, library = tokens.Encoder(VOCABULARY), tokens.library(VOCABULARY)
    got = []
    for _, _, words in slices(pa.array(texts, pa.string()), 50):
        ids, offsets = encoder.ids(words)
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@given(text)
@settings(max_examples=80, deadline=None)
def test_every_prefix_count(t):
    c, library = tc.counter(VOCABULARY), tokens.library(VOCABULARY)
    stored = tc.table(c, t)
    want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
    assert [tc.tokens_of_prefix(stored, k) for k in range(len(t) + 1)] == want
    for budget in range(0, max(want) + 2):
        assert tc.prefix_within(stored, budget) == max(k for k, n in enumerate(want) if n <= budget)


@pytest.mark.parametrize(
    "t",
    [
        "ภาษาไทยที่ไม่มีช่องว่าง" * 30, "one\xa0two\u3000three's " .strip() * 40, "zero\u200bwidth" * 60, "e\u0301a" * 200, "\u1112\u1161\u11ab" * 190, "İxΣ" * 180, "é" * 600 + "'s",
        "!" * 600 + "<|endoftext|>\u0338a's<|endof", "a'" + "re\u0301s'd't!'s" * 70, "क्षत्रिय" * 70, "\u0300" * 600 + "b", "x\u0323\u0323" * 200, "1\u0301'll2've" * 60, "\x01\x1c" * 300 + "'m",
    ],
)
def test_long_odd_words_have_every_prefix_count(t):
    assert len(t) > tc.ODD_CHARS
    library = tokens.library(VOCABULARY)
    want = [len(e.ids) for e in library.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
    stored = tc.table(tc.counter(VOCABULARY), t)
    assert [tc.tokens_of_prefix(stored, k) for k in range(len(t) + 1)] == want
    assert all(tc.prefix_within(stored, n) == max(k for k, m in enumerate(want) if m <= n) for n in (0, want[-1] // 2, want[-1] - 1))


@given(st.lists(st.sampled_from([*"abstremvld''!<|>1İΣKő́\u0301\u0338\u0323\u200b\xa0\u3000", "ก", "ี", "่", "\u1112", "\u1161", "\u11ab", "<|endoftext|>", "\x01", "\u09c7", "\u09be"]), min_size=1, max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_cut_words_have_every_prefix_count(t):
    library = tokens.library(VOCABULARY)
    assert tc.counter(VOCABULARY)._long(t) == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]


def test_full_memories_give_the_same(monkeypatch):
    library = tokens.library(VOCABULARY)
    encoder = tokens.Encoder(VOCABULARY)
    encoder.limit, encoder.bases.limit = 2000, 10
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30)]
    got = []
    for _, _, words in slices(pa.array(texts), 60):
        ids, offsets = encoder.ids(words)
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    """Hashes only find words: with 3 hashes for all words, ids and counts are still the library's."""
    library = tokens.library(VOCABULARY)
    hashes = textkernel.Words.hashes
    monkeypatch.setattr(textkernel.Words, "hashes", lambda self, *a, **k: hashes(self, *a, **k) % np.uint64(3))
    made, totals, tables = tokens.Encoder(VOCABULARY), tc._Totals(tc.counter(VOCABULARY)), tc._Tables(tc.counter(VOCABULARY))
    texts = [" ".join(["same", f"word{i % 7}", f"a{'b' * (i % 9)}c", "x" * 70 + str(i % 2), "é'll", "pneumonoultramicroscopic" + "sS"[i % 2]]) for i in range(20)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    column, got = pa.array(texts, pa.large_string()), []
    for low, high, words in slices(column, 300):
        ids, offsets = made.ids(words)
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        assert totals.of(None, words).tolist() == tables.of(column.slice(low, high - low), words)[1].tolist() == [len(x) for x in want[low:high]]
    assert got == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_every_vocabulary_file_gives_the_library_ids(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    texts = [*(t or "" for t in TEXTS), "Hello  world, 12 apples\n\nand 王"]
    if name.endswith(".json"):
        want = [e.ids for e in tokens.library(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = read_token_records(write_token_records(df, str(tmp_path / "r"), path, end_id=1), str(tmp_path / "r"), with_ids=True).collect()
    assert [r.token_ids for r in sorted(rows, key=lambda r: r.doc_id)] == [[*w, 1] for w in want]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df, path).collect()) == [(i, len(w)) for i, w in enumerate(want)]


def test_other_vocabularies_are_refused_where_the_rule_does_not_hold(tmp_path):
    with pytest.raises(ValueError, match="not those of its words"):
        tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="no library"):
        tokens.encoder(str(tmp_path / "x.tiktoken"))


def test_crc():
    assert _plain(b"123456789") == 0xE3069283  # the published check value
    parts = [b"123456789", b"ab", b"", bytes(range(256)) * 33, b"x" * 64, b"y" * 65]
    assert crc32c_many(parts).tolist() == [_plain(p) for p in parts] == crc32c_many(parts[:1]).tolist() + [_plain(p) for p in parts[1:]]
    assert crc32c_many([]).tolist() == [] and masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def frame_of(spark, texts, extra=True):
    rows = [(None if i == 1 else 100 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"start": F.lit("clash"), "n_tokens": F.lit(None).cast("string")}) if extra else df


def test_token_records(spark, tmp_path):
    library = tokens.library(VOCABULARY)
    texts = [*TEXTS, "tie", "tie"]
    df = frame_of(spark, texts).withColumn("doc_id", F.when(F.col("text") == "tie", 3).otherwise(F.col("doc_id")))
    manifest = write_token_records(df, str(tmp_path / "r"), VOCABULARY)
    rows = read_token_records(manifest, str(tmp_path / "r"), with_ids=True).collect()
    rows = sorted(rows, key=lambda r: r.start)
    ids = [3 if t == "tie" else None if i == 1 else 100 - i for i, t in enumerate(texts)]
    order = sorted(zip(ids, texts), key=lambda x: (-1 if x[0] is None else x[0]))
    at = 0
    for r, (doc_id, t) in zip(rows, order, strict=True):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.token_ids) == (doc_id, at, len(want), zlib.crc32(want.tobytes()), want.tolist())
        at += len(want)
    first = manifest.orderBy("part").first()
    picked = read_records_at(str(tmp_path / "r"), first.file, [first.n_records - 1, 0])
    assert [d for d, _ in picked] == [rows[first.n_records - 1].doc_id, rows[0].doc_id]


def test_broken_record_is_noticed(spark, tmp_path):
    manifest = write_token_records(frame_of(spark, ["some words here"]), str(tmp_path), VOCABULARY)
    path = tmp_path / f"{manifest.first().file}.records"
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        read_token_records(manifest, str(tmp_path)).collect()


def test_no_documents(spark):
    empty = frame_of(spark, ["x"]).where("false")
    assert token_records(empty, VOCABULARY).collect() == [] and token_counts(empty, VOCABULARY).collect() == []


def test_token_counts(spark):
    library = tokens.library(VOCABULARY)
    rows = {(r.doc_id): r for r in token_counts(frame_of(spark, TEXTS), VOCABULARY, limit=100, with_table=True).collect()}
    plain = {r.doc_id: tuple(r) for r in token_counts(frame_of(spark, TEXTS), VOCABULARY, limit=100).collect()}
    for i, t in enumerate(TEXTS):
        key = None if i == 1 else 100 - i
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert plain[key] == (key, len((t or "").encode()), n, n > 100) == tuple(rows[key])[:4]
        assert tc.tokens_of_prefix(bytes(rows[key].prefix_table), len(t or "")) == n


def test_registered_counts_have_tables(spark, sf):
    """The query answers prefix and budget questions on its documents."""
    from plyspark.llm.queries import op5_token_counts

    library, docs = tokens.library(VOCABULARY), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_token_counts(spark, sf).collect()
    assert len(rows) == len(docs) > 0
    for r in rows:
        t, stored = docs[r.doc_id] or "", bytes(r.prefix_table)
        assert stored == tc.table(tc.counter(VOCABULARY), t) and r.n_tokens == tc.tokens_of_prefix(stored, len(t)) and r.over_limit == (r.n_tokens > 2048)
    for r in rows[:40]:
        t, stored = docs[r.doc_id] or "", bytes(r.prefix_table)
        for k in (len(t) // 3, len(t) // 2, len(t)):
            assert tc.tokens_of_prefix(stored, k) == len(library.encode(t[:k], add_special_tokens=False).ids)
        assert len(library.encode(t[: tc.prefix_within(stored, 100)], add_special_tokens=False).ids) <= 100


def test_tables_of_slices(monkeypatch):
    """Wide steps and a full memory give the tables of single texts."""
    c = tc.PrefixCounter(VOCABULARY)
    counts_of = c.counts_of
    monkeypatch.setattr(c, "counts_of", lambda ws: [[n + (300 if w == "wide" and i else 0) for i, n in enumerate(x)] for w, x in zip(ws, counts_of(ws))])
    monkeypatch.setattr(tc._Tables, "limit", 300)
    texts, tables = [*(t or "" for t in TEXTS), "a wide b", "é wide"], tc._Tables(c)
    column = pa.array(texts, pa.large_string())
    for low, high, words in slices(column, 60):
        made, n = tables.of(column.slice(low, high - low), words)
        assert made.to_pylist() == [tc.table(c, t) for t in texts[low:high]]
        assert n.tolist() == [tc.tokens_of_prefix(tc.table(c, t), len(t)) for t in texts[low:high]]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, None), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"),
        ("<title>no</title><script>var x='</p>'</script><style>p{}</style>yes", "yes"), ("<div hidden>x</div><p style='display: none'>y</p>z", "z"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<table><tr><td>ab<td>c<tr><td>d<td>ef</table>", "ab | c\nd  | ef"), ("<pre> a\n  b</pre>", " a\n  b"), ("x &amp; y &#233;", "x & y é"),
        ("a<!-- no --><b>b</b>c", "abc"), ("<select><option>x<option>y</select>", "x\ny"), ("<p>a</b></i></div>b", "ab"), ("<", "<"), ("a < b", "a < b"), ("<a href='x>y'>link</a>", "link"),
        ("<p title=it's>hello</p> world <b>more</b>", "hello\n\nworld more"), ('<a href="x>after the quote', "after the quote"), ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"), ("<svg><text>t</text><title>no</title><![CDATA[x]]></svg><object>o</object>", "txo"), ("<![CDATA[x]]>y", "y"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>d</dialog>z", "s\nt\nyes\nz"), ("<p style='/* display:none */color:red'>seen</p>", "seen"), ("<p style='display:none!important;display:block'>x</p>y", "y"),
        ("a&nbsp;&nbsp;b", "a\xa0\xa0b"), ("<ol><li value=4>a<li>b</ol><ol reversed><li>x<li>y</ol><ol type=i start=3><li>q<li>r</ol>", "4. a\n5. b\n\n2. x\n1. y\n\niii. q\niv. r"), ("a<plaintext><b>x", "a\n\n<b>x"),
        ("<table>astray<thead>too<tr><td>x</thead><tfoot><tr><td>foot</tfoot><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>", "astray\ntoo\nx\nwide cell | z\n1    | 2  | 3\nfoot"), ("<table><td>a<td>b<tr><td>c</table>", "a | b\nc"),
        ("<head><meta charset=x>text", "text"), ("<img alt='pic'>", "pic"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<template>x</template><noscript>y</noscript>", ""), ("<textarea><b>q</b></textarea>", "<b>q</b>"),
    ],
)
def test_page_text(source, want):
    assert html_to_text(source) == want


WORD = re.compile(r"w\d+")


class Visible(HTMLParser):
    """The visible words of well-formed pages, by another way: a stack of what each open element shows."""

    def __init__(self, source):
        super().__init__()
        self.stack, self.words = [True], []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        style, now = dict(attrs).get("style") or "", self.stack[-1]
        if now is not None:
            now = None if tag in ("script", "template") or "hidden" in dict(attrs) or "none" in style else True if "visible" in style else False if "hidden" in style else now
        self.stack.append(now)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.words += WORD.findall(data) if self.stack[-1] else []


def grown(rng, depth=0):
    """A well-formed piece of a page."""
    if depth > 5 or rng.random() < 0.25:
        return f"w{rng.randrange(10**6)} " * rng.randint(0, 3)
    tag = rng.choice(["div", "span", "b", "ul", "table", "section", "blockquote", "pre", "script", "h2"])
    mark = rng.choice([""] * 8 + [" hidden", " style='display: none'", " style='visibility:hidden'", ' style="color:red;visibility:visible"', " title=it's"])
    inner = [grown(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if tag == "ul":
        inner = [f"<li>{x}</li>" for x in inner]
    if tag == "table":
        inner = [f"<tr><td>{x}</td><td>w{rng.randrange(10**6)}</td></tr>" for x in inner]
    if tag == "script":
        inner = ["w1 < w2"]
    return f"<{tag}{mark}>{''.join(inner)}</{tag}>"


def test_generated_pages_show_their_visible_words():
    rng = random.Random(3)
    for _ in range(400):
        source = "".join(grown(rng) for _ in range(3))
        assert sorted(WORD.findall(html_to_text(source))) == sorted(Visible(source).words), source


def test_cells_of_a_column_begin_at_one_place():
    """Grids with colspan and rowspan against a plain map of who takes which square."""
    rng = random.Random(4)
    for _ in range(300):
        taken, place, rows = set(), {}, []
        for y in range(rng.randint(1, 6)):
            cells, x = [f"<td>r{y}"], 1  # each row begins with a cell of its own
            taken.add((y, 0))
            for _ in range(rng.randint(0, 4)):
                while (y, x) in taken:
                    x += 1
                wide, high, word = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3]), f"w{len(place)}" + "x" * rng.randint(0, 6)
                while any((y, c) in taken for c in range(x, x + wide)):
                    wide -= 1
                taken |= {(y + i, x + j) for i in range(high) for j in range(wide)}
                place[word] = (y, x)
                cells.append(f"<td colspan={wide} rowspan={high}>{word}")
                x += wide
            rows.append("<tr>" + "".join(cells))
        lines = html_to_text(f"<table>{''.join(rows)}</table>").split("\n")
        assert len(lines) == len(rows)
        at = {}
        for word, (y, x) in place.items():
            at.setdefault(x, set()).add(lines[y].index(word + " " if word + " " in lines[y] else word))
        assert all(len(v) == 1 for v in at.values()) and [min(at[x]) for x in sorted(at)] == sorted(min(v) for v in at.values())


def test_odd_pages(spark):
    assert html_to_text("<div>" * 50_000 + "deep" + "<div hidden>gone</div>") == "deep" and html_to_text("<table><tr><td>" * 3000 + "x").endswith("x")
    assert html_to_text("<font>" * 20_000 + "<p>a</p></b>" * 2000).count("a") == 2000 and html_to_text('<a b="' * 50_000 + "x") is not None
    assert html_to_text("<table><tr>" + "<td colspan=1000 rowspan=65534>x" * 1000 + "</table>").count("x") == 1000
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, extract_text(df).collect()), key=str) == [(1, "a"), (1, "a"), (None, None)]
    assert extract_text(df.where("false")).collect() == []
