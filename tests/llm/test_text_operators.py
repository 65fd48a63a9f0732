"""Text operators against the tokenizers' libraries, brute force and hand-made cases."""

import base64
import glob
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

from driftweave.llm import bagminhash, htmltext, idstore, mixing, secretscan, sentencepieces, tokencounts, toxicity  # noqa: E402
from driftweave.llm.queries import ORACLES  # noqa: E402

PIECES, BYTES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
rnd = random.Random(1)
ALPHABET = "aaabcdeinortst he.,'  \n\t▁éß漢字🙂́ <s>"
TEXTS = ["", " ", "a", "  a", "a  b ", "a\nb", "a\n \nb", "\t x", "fi ﬁ", "a\x00b", "　x y", "🙂 🙂", "▁a", "<s> a </s>", "x <|endoftext|> y", "it's we'll", "ab" * 3000, "a b " * 3000, "a" * 20_000, " " * 3000]
TEXTS += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def test_piece_encoding_is_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = sentencepieces.Pieces.at(PIECES)
    got = pieces.encode(TEXTS)
    want = sp.encode(TEXTS, num_threads=1)
    assert got.to_pylist() == want
    offsets = np.array(got.offsets).astype(np.int64)
    assert pieces.decode(np.array(got.values).astype(np.int64), offsets).to_pylist() == [sp.decode(x) for x in want]
    for ids in ([1, 264], [264, 1, 264], [2, 259, 264], [0, 264], [131, 13], [200, 264], [1, 2], [28705], []):
        assert pieces.decode(np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist() == [sp.decode(ids)]


UNSPACED = {
    "pieces": lambda n: "".join(rnd.choice(["tion", "the", "er", "and", "in", "ity", "ment"]) for _ in range(n))[:n],
    "letters": lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
    "hex": lambda n: rnd.randbytes(n // 2).hex(),
    "base64": lambda n: base64.b64encode(rnd.randbytes(3 * n // 4)).decode(),
    "ideographs": lambda n: "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(n)),
    "one letter": lambda n: "a" * n,
    "marks": lambda n: "".join(rnd.choice("=-*") for _ in range(n)),
    "spaces": lambda n: "a" + " " * n + "b",
}


@pytest.mark.parametrize("kind", UNSPACED)
def test_long_words_are_the_librarys_in_linear_time(kind):
    import time

    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.Pieces.at(PIECES)
    for n in [*range(100, 400, 7), 5000]:
        x = UNSPACED[kind](n)
        assert pieces.encode([x]).to_pylist()[0] == sp.encode(x)
    x = UNSPACED[kind](200_000)
    began = time.process_time()
    got = pieces.encode([x])
    took = time.process_time() - began
    assert got.to_pylist()[0] == sp.encode(x) and took < 1.5 and x not in pieces.cache


def test_models_that_change_their_text_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, x, **_: ["▁a", "▁b"])
    with pytest.raises(ValueError, match="does not know such models"):
        sentencepieces.Pieces(PIECES)


def test_encode_and_decode_frames(spark):
    df = docs(spark, [None, "", "a b", "a b"]).withColumn("ids", F.lit(7)).withColumn("n_tokens", F.lit("clash"))
    out = sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES)
    rows = out.orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["", "", "a b", "a b"] and rows[0]["n_tokens"] == "clash"
    assert sentencepieces.encode(docs(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("path", [PIECES, BYTES, WORDS])
def test_token_counts(spark, path):
    out = {r["doc_id"]: r for r in tokencounts.count_tokens(docs(spark, [None, *TEXTS]), path).collect()}
    if path.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(TEXTS, num_threads=1)]
    else:
        tk = tokenizers.Tokenizer.from_file(path)
        want = [len(tk.encode(x, add_special_tokens=False).ids) for x in TEXTS]
    assert [out[i + 1]["n_tokens"] for i in range(len(TEXTS))] == want
    assert out[0]["n_tokens"] == out[0]["n_bytes"] == 0
    assert [out[i + 1]["n_bytes"] for i in range(len(TEXTS))] == [len(x.encode()) for x in TEXTS]


def test_token_counts_of_cut_texts():
    long = [" ".join(rnd.choice(["tion", "the", "a", "Ünïcode", "x.", "  ", "\n"]) for _ in range(20_000)) for _ in range(3)]
    for path in (PIECES, BYTES):
        c = tokencounts.Counter.at(path)
        assert c.counts(long).tolist() == [c.count([x])[0] for x in long]
        assert all(len(c.parts(x, 500)) > 50 for x in long)
        assert [sum(c.count(c.parts(x, 500))) for x in long] == [c.count([x])[0] for x in long]


def test_token_counts_of_a_long_text_that_ends_in_a_space():
    c = tokencounts.Counter.at(PIECES)
    for x in ("x" * 600 + " ", "ab cd " * 100, "x" * 600 + " \n"):
        assert sum(c.count(c.parts(x, 500))) == c.count([x])[0]
    x = "abcde" * 3278 + " "
    assert c.counts([x])[0] == c.count([x])[0]


def lists_of(encoder, texts):
    flat, count = encoder.encode(texts)
    assert flat.dtype == encoder.kind and len(flat) == count.sum()
    return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if texts else []


def test_byte_encoding_is_the_librarys():
    tk = tokenizers.Tokenizer.from_file(BYTES)
    enc = idstore.ByteEncoder.at(BYTES)
    for _ in range(2):  # the second time from the cache
        assert lists_of(enc, TEXTS) == [tk.encode(x, add_special_tokens=False).ids for x in TEXTS]
    assert lists_of(enc, []) == []


def test_store_round_trip(spark, tmp_path):
    texts = [*TEXTS[:60], None, "the same text " * 400, "the same text " * 400]
    df = docs(spark, texts).unionByName(docs(spark, [texts[-1]]).withColumn("doc_id", F.lit(61).cast("long"))).repartition(3)
    path = f"file://{tmp_path}/store"
    idstore.write_ids(df, path, BYTES)
    tk = tokenizers.Tokenizer.from_file(BYTES)
    want = sorted((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest(), tuple([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in df.collect())
    got = sorted((r["doc_id"], r["place"], tuple(r["ids"])) for r in idstore.read_ids(spark, path).collect())
    assert got == want
    start = 0
    rows = sorted((tuple(r) for r in idstore.read_digests(spark, path).select("doc_id", "place", "start", "n_tokens", "ids_crc32", "verified").collect()))
    for (i, place, ids), row in zip(want, rows):
        assert row == (i, place, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    chunks = idstore.read_chunks(spark, path)
    assert chunks.count() == chunks.select("key").distinct().count()
    files = spark.read.parquet(f"{path}/manifest").orderBy("file").collect()
    assert sum(f["n_rows"] for f in files) == len(want) and all(a["last_id"] <= b["first_id"] for a, b in zip(files, files[1:]))


def test_store_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    idstore.write_ids(docs(spark, []), path, BYTES)
    assert idstore.read_digests(spark, path).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    """A store in several files, and its path on disk."""
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(1500)) for _ in range(40)] + ["", "", None]
    folder = str(tmp_path / "store")
    idstore.write_ids(docs(spark, texts).repartition(3), f"file://{folder}", BYTES)
    return folder, len(texts)


def parts_of(folder):
    """The data files of a folder, largest first; the checksums beside them go, so that Spark reads what stands there."""
    for x in glob.glob(f"{folder}/.*.crc"):
        os.remove(x)
    return sorted(glob.glob(f"{folder}/part-*"), key=os.path.getsize, reverse=True)


def test_a_lost_chunk_file_is_reported_for_every_document(spark, store):
    folder, n = store
    gone = parts_of(f"{folder}/kind=chunk")[0]
    names = {bytes(r["key"]) for r in spark.read.parquet(gone).select("key").collect()}
    hit = {r["doc_id"] for r in idstore.read_recipes(spark, folder).collect() if names & {bytes(k) for k in r["chunks"]}}
    os.remove(gone)
    rows = idstore.read_digests(spark, folder).collect()
    assert hit and len(rows) == n and {r["doc_id"] for r in rows if not r["verified"]} == hit
    with pytest.raises(Exception, match="missing or was changed"):
        idstore.read_ids(spark, folder).collect()


def test_a_flipped_byte_is_reported_for_every_document(spark, store):
    folder, n = store
    file = parts_of(f"{folder}/kind=chunk")[0]
    row = max(spark.read.parquet(file).collect(), key=lambda r: len(r["data"]))
    raw = bytearray(open(file, "rb").read())
    raw[raw.index(bytes(row["data"])) + 7] ^= 1
    open(file, "wb").write(raw)
    hit = {r["doc_id"] for r in idstore.read_recipes(spark, folder).collect() if bytes(row["key"]) in map(bytes, r["chunks"])}
    rows = idstore.read_digests(spark, folder).collect()
    assert len(rows) == n and {r["doc_id"] for r in rows if not r["verified"]} == hit != set()


@pytest.mark.parametrize("part", ["recipe", "manifest", "head"])
def test_a_lost_file_of_recipes_or_names_is_an_error(spark, store, part):
    folder, n = store
    os.remove(parts_of(f"{folder}/{part}")[0])
    for read in (idstore.read_digests, idstore.read_ids):
        with pytest.raises(idstore.StoreError, match=f"doc_id 0 to 42: 0 of {n} recipes" if part == "recipe" else "manifest|missing"):
            read(spark, folder)


def test_chunks_that_many_recipes_share_and_ids_that_repeat(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "HOT_SAMPLE", 1)
    monkeypatch.setattr(idstore, "RANGE_ROWS", 7)
    monkeypatch.setattr(idstore, "SENT_KEYS", 3)
    texts = [None if i % 3 == 0 else "same words " * 9 if i % 3 == 1 else f"text number {i}" for i in range(90)]
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") < 40, 8).otherwise(F.col("doc_id"))).repartition(3)
    path = f"file://{tmp_path}/hot"
    idstore.write_ids(df, path, BYTES)
    tk = tokenizers.Tokenizer.from_file(BYTES)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).hexdigest())
    want, start = [], 0
    for r in sorted(df.collect(), key=key):
        ids = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        start += len(ids)
    rows = idstore.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "verified").collect()
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want
    files = [r["file"] for r in spark.read.parquet(f"{path}/manifest").orderBy("first_id", "file").collect()]
    assert len(files) > 6 and files == sorted(files)


def test_words_without_one_id_that_begins_with_a_space():
    enc = idstore.ByteEncoder(BYTES)
    enc.starts[:] = False
    tk = tokenizers.Tokenizer.from_file(BYTES)
    assert lists_of(enc, TEXTS) == [tk.encode(x, add_special_tokens=False).ids for x in TEXTS]


def test_chunks_follow_content():
    ids = np.random.RandomState(1).randint(0, 50_000, 40_000)
    table = idstore.gear(1 << 17)
    a = idstore.cuts(ids, np.array([len(ids)]), table)[0]
    b = idstore.cuts(np.concatenate([ids[:5], ids]), np.array([len(ids) + 5]), table)[0]
    assert len({x + 5 for x in a} & set(b)) > 0.9 * len(a) and max(np.diff([0, *a])) <= idstore.MOST


def test_crc_of_parts():
    parts = [bytes(rnd.randrange(256) for _ in range(4 * rnd.randint(0, 700))) for _ in range(40)]
    owner = np.sort(np.array([rnd.randrange(5) for _ in parts]))
    got = idstore.crc_whole(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), owner, 5)
    assert got.tolist() == [zlib.crc32(b"".join(p for p, o in zip(parts, owner) if o == k)) for k in range(5)]


# secrets


def base_by_hand(x):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    s = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


KEY = "Zk3vQ9xT1mB7pLw0RsYd5HnC8uJfGa2EiXo6KtVq"
SECRETS = [
    None, "", "nothing here", 'password = "hunter22"', "PassWord:abc", "secret=token: abcdefgh", "ſecret=abcdefgh", "apikey=1234567 api_key: 'abc.def='", "é" * 50 + " token=abcdefgh",
    "AKIA" + "A" * 15, "AKIA" + "Z9" * 8, "xAKIAAKIA" + "Q" * 16, "0" * 23, "deadbeef" * 3, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", f"see {KEY} there", "a" * 200_000,
]


def test_base_spans():
    for x in SECRETS:
        assert secretscan.base_spans(x or "") == base_by_hand(x or ""), x
    for _ in range(300):
        x = "".join(rnd.choice(["token", "secret", "=", ":", " ", '"', "abc", "AKIA", "ABCDEF12", "0123abcd", ".", "é"]) for _ in range(30))
        assert secretscan.base_spans(x) == base_by_hand(x)


def test_scan_adds_random_keys_and_leaves_prose(spark):
    prose = ["the quick brown fox jumps over extraordinarilylongcompoundwordsthatgoonandon", "some_long-hyphenated-identifier_name_of_a_thing/with/paths/and_more", "Donaudampfschifffahrtsgesellschaftskapitaen 4691172130117446"]
    out = {r["doc_id"]: r["spans"] for r in secretscan.scan(docs(spark, [*SECRETS, *prose])).collect()}
    for i, x in enumerate(SECRETS):
        assert [(s["start"], s["kind"], s["end"]) for s in out[i] if s["kind"] < 3] == base_by_hand(x or "")
    at = SECRETS.index(f"see {KEY} there")
    assert [(s["start"], s["kind"], s["end"]) for s in out[at]] == [(4, 3, 4 + len(KEY))]
    assert all(out[len(SECRETS) + i] == [] for i in range(len(prose)))
    assert secretscan.scan(docs(spark, [])).count() == 0


def test_keys_behind_a_name_are_candidates():
    for x, at in ((f"AWS_KEY={KEY}", 8), (f"see https://x.org/a?sig={KEY}&b=1", 24), (f"a_rather_long_name_of_a_setting={KEY}", 32), (f"auth={KEY}==", 5)):
        end = at + len(KEY) + 2 * x.endswith("==")
        assert [c[:2] for c in secretscan.candidates(x, secretscan.base_spans(x))] == [(at, end)], x


def test_battery_keeps_random_strings():
    draw = random.Random(4)
    for name, alphabet in secretscan.ENCODINGS.items():
        passed = sum(min(secretscan.battery("".join(draw.choice(alphabet) for _ in range(40)), name)) >= secretscan.BATTERY for _ in range(200))
        assert passed >= 190, name
    assert min(secretscan.battery("ab" * 20, "hex")) < secretscan.BATTERY


def test_redact(spark):
    df = docs(spark, SECRETS)
    out = {r["doc_id"]: r for r in secretscan.redact(df).collect()}
    assert out[0]["text"] is None and out[1]["text"] == "" and out[3]["text"] == "[secret]\"" and out[14]["text"] == '[secret]"'
    assert out[2]["text"] == "nothing here" and out[3]["n_chars"] == len(out[3]["text"]) and len(out) == len(SECRETS)


# mixing


def test_poisson_inverts_the_distribution(spark):
    import math

    df = spark.range(4000).withColumn("mean", F.when(F.col("id") % 2 == 0, F.lit(0.7)).otherwise(F.lit(40.0)))
    rows = df.withColumn("n", mixing.poisson(F.col("mean"), F.col("id").cast("string"), F.lit("1"))).collect()
    for r in rows[::200]:
        if r["mean"] < 16:
            u = int(hashlib.md5(f"{r['id']}:1:1".encode()).hexdigest()[:13], 16) / 2**52
            k, c = 0, math.exp(-0.7)
            while c <= u:
                k += 1
                c += math.exp(-0.7) * 0.7**k / math.factorial(k)
            assert r["n"] == k
    for mean in (0.7, 40.0):
        own = [r["n"] for r in rows if r["mean"] == mean]
        assert np.mean(own) == pytest.approx(mean, rel=0.08) and np.var(own) == pytest.approx(mean, rel=0.15)


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    df = docs(spark, ["a b c", "d e", None, "x"]).withColumn("source", F.when(F.col("doc_id") < 3, F.col("source"))).withColumn("rate", F.lit(9)).withColumn("copy", F.lit(5))
    out = mixing.mix(df.drop("copy"), weights={"s0": 5.0})
    assert {r["source"] for r in out.collect()} <= {"s0"}
    one = mixing.rates(docs(spark, ["aaaa", "bb", "cc", "dddd"]), weights={"s0": 1.0, "s1": 1.0}, total=24.0)
    assert {r["source"]: r["rate"] for r in one.collect()} == {"s0": pytest.approx(12 / 8), "s1": pytest.approx(6.0), "s2": 0.0}


# web pages


def test_extract(spark):
    pages = [
        None, "", "no tags at all", "<p>One &amp; two</p><p>three<br>four</p>",
        "<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article><h1>T&eacute;st</h1><p>Some  long\n text here.</p><aside>Related things to read now</aside><p>More text.</p><div class=comments><p>First!</p></div></article><footer>bye</footer>",
        "<script>var t='</p>';</script><style>p{}</style><!-- <p>x</p> --><p>Kept text is here</p><form>Name <input></form>",
        "<p" * 50_000,
        "<body><form id=aspnet><div class='content with-sidebar'><p>All of this page stands in a form.</p></div><div class='sidebar'>Side</div></form>",
    ]
    df = spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert got[0] == got[1] == "" and got[2] == "no tags at all" and got[3] == "One & two\n\nthree four"
    assert got[4] == "Tést\n\nSome long text here.\n\nMore text." and got[5] == "Kept text is here" and got[6] == ""
    assert got[7].startswith("All of this page stands in a form.")


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p>We went to <a href="/hidden/place">the mill</a> last year, and stayed there for a whole day and a night.</p>', "We went to the mill last year, and stayed there for a whole day and a night."),
        ("<p>We went to <a href=/x?id=ad>the mill</a> last year, and stayed there for a whole day and a night.</p>", "We went to the mill last year, and stayed there for a whole day and a night."),
        ('<div title="The hidden valley" data-x=\'class="ad"\'><p>Words of the page.</p></div>', "Words of the page."),
        ('<div class="overflow-hidden"><p>Words of the page.</p></div><footer>bye</footer>', "Words of the page."),
        ('<div class="elementor-widget-text"><p>Words of the page.</p></div><p>And more.</p>', "Words of the page.\n\nAnd more."),
        ('<p>Before it.</p><svg width="1"/><p>Words behind.</p>', "Before it.\n\nWords behind."),
        ("<p>Before it.</p><select name=x><p>Words behind.</p>", "Before it.\n\nWords behind."),
        ("<p>Before it.</p><svg><path d='x'/><text>no</text></svg><p>Words behind.</p>", "Before it.\n\nWords behind."),
        ('<p>Kept words here.</p><div hidden>not this</div><div class="hidden">nor this</div><p CLASS=ad>nor that</p><p>More words.</p>', "Kept words here.\n\nMore words."),
    ],
)
def test_only_real_marks_leave_words_out(page, want):
    # a second paragraph in front, so that a page whose every word is marked is not read leniently
    weights = htmltext.fit_weights(htmltext.labelled_pages())
    assert htmltext.main_text(f"<p>First of all.</p>{page}", weights) == f"First of all.\n\n{want}"


HERE = "<p>Words of the article are here.</p>"
SAID = "Words of the article are here."
NUMBERS = [" ".join(str(i * j) for j in range(12)) for i in range(9)]


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article>{HERE}<ul><li>First<ul class="menu"><li>Home page here</li><li>Other</li></ul></li></ul>{HERE}</article>', [SAID, "First", SAID]),
        (f'<article>{HERE}<ul><li><div class="ad"><ul><li>Sale now</li><li>And here</li></ul></div></li></ul>{HERE}</article>', [SAID, SAID]),
        (f'<article>{HERE}<table><tr><td class="ad"><table><tr><td>Buy</td></tr><tr><td>now</td></tr></table></td></tr></table>{HERE}</article>', [SAID, SAID]),
        ("<article><ul><li>One two three<li>four five</ul></article><header>Head of the site</header>", ["One two three", "four five"]),
        ("<article><p>One two three<p>four five</article><header>Head of the site</header>", ["One two three", "four five"]),
        (f'<article>{HERE}<div class="popular-science">{HERE}</div><p class="legal">Legal words.</p><div class="discussion">We discuss it.</div><p class="share-price">It rose.</p></article>', [SAID, SAID, "Legal words.", "We discuss it.", "It rose."]),
        (f'<article>{HERE}<div class="related-posts">Read it</div><div class="ad-slot-3">Buy it</div><div id="comments-list">First!</div><ul class="dropdown-menu"><li>Home</li></ul><div class="site-notice">We moved.</div>{HERE}</article>', [SAID, SAID]),
        (f"<article>{HERE}<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r.split()) + "</tr>" for r in NUMBERS) + f"</table>{HERE}</article>", [SAID, *NUMBERS, SAID]),
        ('<p>See <a title="foo>the bar</a> there, and all of that is good to see again.</p>', ["See the bar there, and all of that is good to see again."]),
        ("<p>Press <button>OK</button> to go on, and <label>never</label> look back.</p>", ["Press to go on, and look back."]),
        ('<p>Read on <span class="ad">buy this</span> and on and <b>on</b>.</p>', ["Read on and on and on."]),
        (f"<div>Some words in front of it.</div><article>{HERE}</article><div>Some other words behind the article, in a block without a name.</div>", [SAID]),
        (f"<article><b>Bold <div>in a block</b> goes on.</div>{HERE}</article>", ["Bold", "in a block goes on.", SAID]),
    ],
)
def test_structure_decides_what_is_beside_the_text(page, want):
    assert htmltext.main_text(page, htmltext.fit_weights(htmltext.labelled_pages())) == "\n\n".join(want)


@pytest.mark.parametrize("part", ["<div>", "</p>", "<li>", "<td>", "<a>", '<a title="', "<a '", "<script ", "<svg>", "<!--", "<ul><li>", "<b><div></b>"])
def test_hostile_pages_take_linear_time(part):
    import time

    weights = htmltext.fit_weights(htmltext.labelled_pages())
    for page in (part * 20_000, "<div>" * 20_000 + part * 20_000):
        began = time.process_time()
        htmltext.main_text(page, weights)
        assert time.process_time() - began < 5  # twice as long a page takes about twice as long; quadratic ways take minutes


def test_weights_give_back_labelled_pages_that_they_have_not_seen():
    weights = htmltext.fit_weights(htmltext.labelled_pages())
    assert weights["word:text"] > 0 > weights["word:side"] and all(v <= 0 for k, v in weights.items() if k[:4] == "tag:")
    for first, count in ((0, 24), (24, 200)):
        assert all(htmltext.main_text(page, weights) == main for page, main in htmltext.labelled_pages(first, count))


def test_best_run_is_the_brute_force_maximum():
    for _ in range(500):
        scores = [rnd.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rnd.randint(0, 12))]
        runs = [(sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        first, end = htmltext.best_run(scores)
        assert sum(scores[first:end]) == max([0, *(r[0] for r in runs)])
        assert (first < end) == any(r[0] > 0 for r in runs)


def test_extract_of_nothing_and_of_repeated_rows(spark):
    page = f"<article>{HERE}</article>"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "u", f"<p>{'long text ' * 300_000}</p>", "y")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, len(r["text"])) for r in htmltext.extract(df).collect()))
    assert got == [(0, 0), (1, len(SAID)), (1, len(SAID)), (2, 2_999_999)]
    assert htmltext.extract(df.where("page_id < 0")).count() == 0


# near-duplicates


def brute_classes(texts):
    from collections import Counter

    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = sum((bags[a] & bags[b]).values())
            if both and both / sum((bags[a] | bags[b]).values()) >= 0.8:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(texts))]


def near_texts():
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(5, 160))] for _ in range(25)]
    out = [None, "", "   ", "one two", "one two", "One  TWO", "one two three", "same word " * 300, "same word " * 290]
    for b in base:
        for _ in range(draw.randint(1, 9)):
            c = list(b)
            for _ in range(draw.randint(0, max(1, len(b) // 20))):
                c[draw.randrange(len(c))] = draw.choice(vocabulary)
            out.append(" ".join(c))
    return out


def test_classes_match_brute_force(spark):
    texts = near_texts()
    out = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_classes(texts)


def test_blocks_of_a_bucket_find_what_the_leader_does_not(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 4)
    texts = near_texts()
    out = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_classes(texts)


def test_keep_one(spark):
    texts = near_texts()
    roots = brute_classes(texts)
    df = docs(spark, texts)
    again = df.where("doc_id in (3, 40)")
    kept = bagminhash.keep_one(df.unionByName(again)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, r in enumerate(roots) if i == r)
    assert bagminhash.keep_one(docs(spark, [])).count() == 0


def test_signatures_are_unbiased():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [draw.choice(words) for _ in range(300)]
    many = []
    for k in range(0, 60, 5):
        d = list(base)
        for _ in range(k):
            d[draw.randrange(300)] = draw.choice(words)
        many.append(d)
    many += [["a"] * 200, ["a"] * 150 + ["b"] * 20, []]
    sig = bagminhash.signatures(*bagminhash.shingles(many), len(many), m=4096)
    for k in range(12):
        assert (sig[0] == sig[k]).mean() == pytest.approx(bagminhash.similarity(" ".join(base), " ".join(many[k])), abs=0.04)
    assert (sig[12] == sig[13]).mean() == pytest.approx(bagminhash.similarity(" ".join(many[12]), " ".join(many[13])), abs=0.04)
    assert not sig[14].any()


# toxicity


def toxic_rows(n=600):
    draw = random.Random(2)
    plain = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [draw.choice(plain) for _ in range(draw.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            w[draw.randrange(len(w))] = "zxqv" + draw.choice("aeiou") + draw.choice("rst")
        rows.append((i, " ".join(w), "en" if i % 3 else "de", "s", len(w), int(bad)))
    return rows


def test_classifier_learns_and_scores_held_out_rows(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([r[:5] for r in rows] + [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "word " * 40_000, "xx", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = sum((got[r[0]] >= 0.5) == bool(r[5]) for r in held)
    assert len(held) > 80 and right / len(held) > 0.95
    assert all(0.0 <= v <= 1.0 for v in got.values()) and len(got) == len(rows) + 3
    kept = {r["doc_id"] for r in toxicity.keep_clean(df, model).collect()}
    assert {9001, 9002, 9003} <= kept


def test_classifier_counts_every_labelled_row_and_whole_texts(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    own = [i for i in range(9000) if fold(i) in (1, 2, 3)]
    # each word stands in four rows, the fewest that count; a toxic row's mark comes after 21,000 characters
    text = {i: f"word{k % (len(own) // 4)}q common" for k, i in enumerate(own)}
    marked = [i for i in range(9000, 9250)]
    rows = [(i, t, "en", "s", 1) for i, t in text.items()] + [(i, "calm " * 4200 + "zxqvar", "en", "s", 1) for i in marked] + [(i + 1000, "calm " * 4200, "en", "s", 1) for i in marked]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] in marked)) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), labels)
    words = sorted({t.split()[0] for t in list(text.values())[: len(own) // 4 * 4]})
    buckets, starts = toxicity.hashes(words)
    assert len(words) > 1300 and model.table[buckets[starts]].any(axis=1).all()
    assert (model.scores(["calm " * 5000 + "zxqvar", "calm " * 5000, "common"]) >= 0.5).tolist() == [True, False, False]


def test_chains_learn_from_all_rows_however_the_table_is_cut(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 25)
    monkeypatch.setattr(toxicity, "ROUND_STEPS", 10)
    rows = toxic_rows(6000)
    df = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int")
    read = []
    learnt = toxicity._learnt
    monkeypatch.setattr(toxicity, "_learnt", lambda own, chains, *a: (read.append((chains, own.count())), learnt(own, chains, *a))[1])
    model = toxicity.fit(df, labels)
    assert sum(n for _, n in read) == sum(zlib.crc32(str(r[0]).encode()) % 5 in (1, 2, 3) for r in rows)
    assert {c for c, _ in read} == {2} and len(read) == 3
    other = toxicity.fit(df.repartition(7), labels.repartition(3))
    assert np.array_equal(model.table, other.table) and np.array_equal(model.small(), other.small())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean((model.scores([r[1] for r in held]) >= 0.5) == [bool(r[5]) for r in held]) > 0.95


def test_limits_of_all_rows_are_those_of_rows_in_memory(spark):
    draw = np.random.RandomState(4)
    rows = [(str(k % 3) if k % 7 else None, int(y), float(np.round(draw.randn() + y, 1 + k % 2))) for k, y in enumerate(draw.rand(3000) < 0.2)]
    rows += [("one class", 0, 1.0), ("apart", 1, 2.0), ("apart", 0, 1.0), ("last", 1, -1.0), ("last", 1, 0.5), ("last", 0, 0.0), ("equal", 1, 3.0), ("equal", 0, 3.0)]
    got = toxicity.best_gaps(spark.createDataFrame(rows, "lang string, toxic int, z double").repartition(5), F.col("lang"))
    assert set(got) == {"0", "1", "2", "apart", "last", "equal"}
    for lang, (top, low, toxic, clean) in got.items():
        z, y = (np.array([r[c] for r in rows if r[0] == lang]) for c in (2, 1))
        assert (top - 1.0 if low is None else (top + low) / 2) == toxicity.best_limit(z, y) and (toxic, clean) == (y.sum(), len(y) - y.sum())


def test_bitmap_of_labels_leaves_all_labelled_rows(spark, monkeypatch):
    df = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    own = spark.range(-6000, 6000, 7).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    few = {tuple(r) for r in toxicity.labelled(df, own, own.count()).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    many = toxicity.labelled(df, own, own.count())
    assert len(few) > 800 and {tuple(r) for r in many.collect()} == few and many.columns == ["doc_id", "text", "toxic"]
    assert "bitmap" in many._jdf.queryExecution().toString()


def test_classifier_without_labels(spark):
    df = docs(spark, ["a", None])
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in toxicity.score(df, model).collect()] == pytest.approx([0.0, 0.0], abs=1e-6)


def test_score_does_not_depend_on_batches():
    rows = toxic_rows(80)
    model = toxicity.train([r[1] for r in rows], [r[5] for r in rows])
    texts = [r[1] for r in rows]
    one = np.array([model.bare().scores([t])[0] for t in texts])
    assert np.allclose(one, model.bare().scores(texts), atol=1e-5)


def test_sql_is_there_where_sql_can_express_it():
    assert set(ORACLES) == {"op4_top_k", "op5_vector_classes", "op6_mixing"}


def test_trimmed_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(idstore, "CACHE_WORDS", 40)
    tk = tokenizers.Tokenizer.from_file(BYTES)
    enc = idstore.ByteEncoder(BYTES)
    for k in range(30):
        texts = [" ".join(rnd.choice(["the", "a", "of", f"w{k}{rnd.random()}"]) for _ in range(60)), *TEXTS[k : k + 3]]
        assert lists_of(enc, texts) == [tk.encode(x, add_special_tokens=False).ids for x in texts]
    enc._trim()
    assert {"the", "a", "of"} <= set(enc.places) and len(enc.places) <= 20
