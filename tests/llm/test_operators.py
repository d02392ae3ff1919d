"""Each operator against brute force, round trips or held-out accuracy, and on awkward tables."""

import base64
import hashlib
import json
import random
import re
import string
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, language, licenses, minhash, pii, queries, secrets, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, key string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BPE, PIECE = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and letterless texts, a very long one, repeated
    rows, ids that two texts share, columns that an operator might add itself."""
    long = "lorem ipsum dolor sit amet consectetur " * 12_000
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "123 !!"), (5, long), (6, "One two three four five six."), (6, "One two three four five six."), (6, "other words here"), (None, "no id at all here"), (None, None), (7, "ÀÉ ſ K ▁ <|endoftext|> 🙂  x"), (8, "One two three four five six.")]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None, "clash", None, "k") for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(texts):
    library, own = tokenizers.Tokenizer.from_file(BPE), bpe.Tokenizer(BPE)
    rng = random.Random(1)
    alphabet = [*"ab 'st\n\t\r1.,!", "é", "ß", "中", "🙂", " ", " ", "՘", "ẞ", "١", "\x1c", "\x85", "<|endoftext|>"]
    made = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    for text in [*list(texts.values())[:60], *made, "x" * 3000, "ab" * 2000, ""]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(docs, texts):
    library = tokenizers.Tokenizer.from_file(BPE)
    rows = bpe.roundtrip_digests(docs, BPE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_decodes_ids_that_no_text_has(spark):
    rows = spark.createDataFrame([(1, [222, 50256, 100]), (2, None), (3, [])], "doc_id long, ids array<int>")
    library = tokenizers.Tokenizer.from_file(BPE)
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, BPE).collect()} == {1: library.decode([222, 50256, 100], skip_special_tokens=False), 2: "", 3: ""}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components_of(points):
    """By brute force: the smallest id reachable over fingerprints two bits apart at most."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for p, i in points.items():
        least[find(p)] = min(least.get(find(p), i), i)
    return {p: least[find(p)] for p in points}


def test_simhash_fingerprints(docs, texts):
    for r in simhash.report(docs).collect():
        assert r.fingerprint == f"{fingerprint(texts[r.doc_id]):016x}"


def test_simhash_links_and_components(spark):
    """Chains, balls crowded beyond what is paired out, bits in one segment and in two."""
    rng = random.Random(3)
    points = {}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            points.setdefault(p, rng.randrange(10**6))
            for _ in range(rng.randrange(4)):
                p ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    for i in range(64):
        points.setdefault(ball ^ (1 << i), rng.randrange(10**6))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    fps = spark.createDataFrame([(signed(p), i) for p, i in points.items()], "fp long, least long")
    linked = simhash.links(fps)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in linked.collect())
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(linked).collect()}
    want = components_of(points)
    groups = {}
    for p in points:
        groups.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(p for p in points if want[p] == w) for w in set(want.values()))


def test_simhash_keeps_one(docs, texts, awkward, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    points = {}
    for i, t in sorted(texts.items()):
        points.setdefault(fingerprint(t), i)
    want = components_of(points)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    left = [(r.doc_id, r.text) for r in simhash.keep_one(awkward).collect()]
    assert len(left) == len({fingerprint(t) for _, t in left}) and (8, "One two three four five six.") not in left
    assert (2, "") not in left and (1, None) in left and left.count((6, "One two three four five six.")) == 1
    assert simhash.keep_one(empty).count() == 0


def test_language_is_learnt(docs, texts):
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out and len(texts[r.doc_id]) > 40]
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.keep_known(docs, language.learn(docs)).count() == len(texts)


def test_language_of_texts_without_letters(spark, docs):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 ..\u0301"), (4, "кошка"), (5, "the and that with")], "doc_id long, text string")
    profiles = language.learn(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows, profiles, ["doc_id"]).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4] == ("de", 0.0) and out[5][0] == "en"
    assert {r.doc_id for r in language.keep_known(rows, profiles).collect()} == {5}


def test_language_far_from_all_profiles(spark, docs):
    """Other languages in the same letters, and letter noise, are nobody's; their letters are in every profile."""
    rng = random.Random(2)
    noise = "".join(rng.choices(string.ascii_lowercase + "     ", k=600))
    italian = "La mattina presto il vecchio pescatore scese verso il porto portando con sé la rete che aveva riparato durante la notte e guardava il mare mentre gli altri uomini dormivano ancora"
    polish = "Wczesnym rankiem stary rybak zszedł do portu niosąc sieć którą naprawił w nocy i spojrzał na morze"
    english = "Early in the morning the old man and the other men of the house went to the river and there they ate and then they rested in the shade"
    rows = spark.createDataFrame(list(enumerate([noise, italian, polish, "xqzj kwvx " * 40, english, None])), "doc_id long, text string")
    assert [r.doc_id for r in language.keep_known(rows, language.learn(docs)).collect()] == [4]


def test_language_learns_from_every_row(spark):
    """Counts and bounds against plain ones, on more rows than were drawn of a language once."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(21_000)]
    profiles = language.learn(spark.createDataFrame([(k, t, "xx") for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    every = language.ranked(np.concatenate([language.ngrams(t) for t in texts]), language.RANKS)
    assert profiles.grams[np.argsort(profiles.ranks[0])].tolist() == every.tolist()
    away = {}
    for t in texts:
        n, x = profiles.distances(t)
        away.setdefault(language.size(n), []).append(float(x.min()))
    for k, found in away.items():
        if len(found) >= language.LEAST:
            q = sorted(found)[-(-9 * len(found) // 10) - 1]
            assert profiles.bounds[k] == q + language.BEYOND * (1 - q)


def test_language_distances_are_computed_once(docs, monkeypatch):
    """One pass through Python: two in a task need twice the workers, and their memory."""
    plans, write = [], language.materialise
    monkeypatch.setattr(language, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    language.learn(docs)
    assert [len(re.findall("ArrowEvalPython|MapInArrow", p)) for p in plans] == [1]


def test_language_distance_by_brute_force():
    """Ranks and out-of-place distance as plain Python has them."""

    def grams(text):
        count = {}
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g.strip() and (n > 1 or g != " "):
                        count[g] = count.get(g, 0) + 1
        code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return [code(g) for g in sorted(count, key=lambda g: (-count[g], code(g)))]

    text = "The the cat. Été, l'été! a b"
    assert language.ranked(language.ngrams(text), 1000).tolist() == grams(text)
    learnt = {"en": "the cat and the dog went there and then", "fr": "le chat et le chien sont là avec été", "de": "die katze und der hund sind dort über"}
    profiles = {k: grams(v)[: language.RANKS] for k, v in learnt.items()}
    every = sorted({g for p in profiles.values() for g in p})
    ranks = np.full((3, len(every)), language.RANKS)
    names = sorted(profiles)
    for i, k in enumerate(names):
        for r, g in enumerate(profiles[k]):
            ranks[i, every.index(g)] = r
    own = language.Profiles(tuple(names), np.array(every, np.int64), ranks)
    for text in (*learnt.values(), "the chat", "hund und cat", "zzz", "Été là-bas, over there"):
        mine = grams(text)[: language.COMPARED]
        away = [sum(abs(profiles[k].index(g) - r) if g in profiles[k] else language.RANKS for r, g in enumerate(mine)) / (language.RANKS * len(mine)) for k in names]
        assert own.distances(text)[1].tolist() == pytest.approx(away)
        first = min(range(3), key=lambda i: away[i])
        assert own.predict(text) == (names[first], pytest.approx(1 - away[first] / sorted(away)[1]))


def test_language_of_dirty_columns(spark, docs, monkeypatch):
    """More languages than may have profiles, rows without id, copies of one text."""
    monkeypatch.setattr(language, "LANGUAGES", 4)
    dirty = docs.unionByName(docs.withColumn("lang", F.concat(F.lit("x"), "doc_id")), allowMissingColumns=True).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert language.learn(dirty).languages == language.learn(docs).languages


def test_minhash_estimates(docs, texts):
    ids = sorted(texts, reverse=True)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    rows = {r.doc_id: r for r in minhash.edited_report(docs).collect()}
    off = []
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(text)
        for near, other in ((rows[i].near_edited, edited), (rows[i].near_next, after)):
            a, b = shingles(text), shingles(other)
            off.append(near - len(a & b) / max(1, len(a | b)))
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.15


def test_minhash_neighbours_of_shared_and_missing_ids(spark, monkeypatch):
    """Runs are cut inside an id that most rows share and among rows without one."""
    monkeypatch.setattr(minhash, "RUN_BYTES", 200)
    rng = random.Random(11)
    rows = [(rng.choice([5, 5, 5, None, None, *range(9)]), f"text {rng.randrange(60)} " + "w " * rng.randrange(20)) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    firsts, _ = minhash.runs_of(docs, "doc_id", "text")
    assert len({o for o, _ in firsts}) < len(firsts) > 12
    edited = minhash.edited_report(docs).collect()
    assert sorted(map(str, (r.doc_id for r in edited))) == sorted(str(i) for i, _ in rows)
    # the rows in order form one ring: each row is followed by the next
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("d")).collect()
    ring = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.d))
    want = []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        third = len(a.text) // 3
        want.append((str(a.doc_id), hashlib.sha256((a.text[: len(a.text) - third] + b.text[:third]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in edited) == sorted(want)


def test_minhash_long_text_in_parts(monkeypatch):
    words = [f"w{k}" for k in range(5000)]
    whole = minhash.signature(" ".join(words))
    monkeypatch.setattr(minhash, "PART", 700)
    assert (minhash.signature(" ".join(words)) == whole).all()
    assert minhash.likeness(minhash.unpacked(minhash.packed(whole)), whole) == 1 and minhash.likeness(None, whole) == 0 and minhash.likeness(None, None) == 1


def length(n):
    return bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def element(tag, *parts):
    body = b"".join(parts)
    return bytes([tag]) + length(len(body)) + body


def test_secrets_need_structure():
    rng = random.Random(5)
    number = lambda n: element(2, b"\x01" + rng.randbytes(n))
    rsa = element(0x30, element(2, b"\0"), number(128), element(2, b"\x01\x00\x01"), *(number(64) for _ in range(6)))
    pkcs8 = element(0x30, element(2, b"\0"), element(0x30, element(6, b"\x2a\x86\x48"), element(5)), element(4, rsa))
    field = lambda b: len(b).to_bytes(4, "big") + b
    container = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 30) + field(b"s" * 60)
    b64 = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = ".".join([url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub": 1}'), url(rng.randbytes(32))])
    wrapped = "\n".join(re.findall(".{1,64}", b64(pkcs8)))
    for text, kind in ((f"k {b64(rsa)} z", "der"), (f"-----\n{wrapped}\n-----", "der"), (f"x {container.hex()} y", "openssh"), (f"auth {token}!", "jwt")):
        assert kind in [s[0] for s in secrets.spans_of(text)], kind
    for text in (b64(rsa[:-1]), b64(rng.randbytes(200)), b64(pkcs8 + b"\0"), url(b"{}") + "." + url(b"{}") + ".xxxxxxxx"):
        assert not [s for s in secrets.spans_of(f"a {text} b") if s[0] in ("der", "openssh", "jwt")]


def test_secrets_end_where_their_lengths_say():
    """Keys of all lengths mod 3 between dashes, before prose and one after the other; tokens behind a dotted part."""
    rng = random.Random(6)
    field = lambda b: len(b).to_bytes(4, "big") + b
    for n in range(57, 63):
        sec1 = element(0x30, element(2, b"\x01"), element(4, rng.randbytes(32)), element(0xA1, rng.randbytes(n)))
        container = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 30) + field(b"s" * n)
        for key, kind in ((sec1, "der"), (container, "openssh")):
            for padded, newline in ((True, "\n"), (False, "\n"), (False, "\r\n"), (True, "\\n"), (False, "\\r\\n")):
                body = newline.join(re.findall(".{1,64}", base64.b64encode(key).decode()))
                body = body if padded else body.rstrip("=")
                for before, after in (("-----BEGIN KEY-----", "-----END KEY-----"), ("it reads", "word after it"), ("", "w" * 70), ("a/path/" * 8, ""), ("x", body)):
                    text = f"{before}{newline}{body}{newline}{after}"
                    at = len(before + newline)
                    want = [(kind, at, at + len(body))] + ([(kind, len(text) - len(body), len(text))] if after == body else [])
                    assert [s for s in secrets.spans_of(text) if s[0] in ("der", "openssh", "jwt")] == want
    url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = ".".join([url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub": 1}'), url(rng.randbytes(32))])
    for before in ("", "session12.", "a.b.", "session12.longer-part.", ".", f"{token}."):
        found = [s for s in secrets.spans_of(f"id {before}{token} z") if s[0] == "jwt"]
        assert found[-1] == ("jwt", 3 + len(before), 3 + len(before + token)) and len(found) == 1 + (token in before)


def test_secrets_base_by_brute_force(spark):
    rng = random.Random(7)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123456789abcdef", "é", "ſecret", "toKen", "\n", "x", "+/_.-"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(2000)]

    def brute(text):
        out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
        out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))

    rows = secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in secrets.BASE_KINDS]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.report(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r for r in rows if r.toxic == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) < 0.01 * len(clean)


def test_toxicity_beats_flipped_marks(spark):
    """A tenth of the marks that teach are wrong: the posterior and the classifier know better, and the
    label model sees that the marks are less accurate than they were."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    flip = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    flipped = labels.withColumn("toxic", F.when(flip, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.learn(docs, flipped, ~toxicity.held_out())
    label = model.label_model
    true = labels.where(~toxicity.held_out()).select("doc_id", "toxic")
    scored = toxicity.score(docs.join(true, "doc_id"), model, ["doc_id", "toxic"]).withColumn("flipped", flip).collect()
    wrong = sum(r.flipped for r in scored)
    assert sum((r.score >= 0.5) != (r.toxic == 1) for r in scored) < 0.4 * wrong
    assert label.rates[1, 0] < 0.95 and label.rates[0, 0] > 0.05  # how often the mark fires in either class
    assert label.correlations.shape[0] == len(label.rates[0]) and abs(label.prior - 0.11) < 0.05


def test_toxicity_reads_whole_texts():
    text = "AbcdefgHijklmnOpqrstuVwxyz and more of it"
    assert not any(toxicity.shouts(text[k:]) for k in range(8)) and toxicity.shouts("STOP SHOUTING AT me OVER THERE") and not toxicity.shouts("SHORT")
    assert toxicity.shouts("é" * 30 + "É" * 31) and not toxicity.shouts("中" * 40)


def test_generative_model_finds_the_classes():
    """Voters of known accuracy, two of them copies of each other."""
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    rates = [(0.02, 0.7), (0.05, 0.6), (0.1, 0.8), (0.3, 0.35), (0.03, 0.5)]
    votes = np.stack([np.where(y, rng.random(4000) < b, rng.random(4000) < a) for a, b in rates], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, 3:4]], axis=1)
    posterior = toxicity.generative_model(votes, np.ones(4000), np.where(votes[:, 0] == 1, 0.9, 0.05)).posterior
    assert ((posterior > 0.5) == y).mean() > 0.93


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        rows = token_counts.count(docs, PIECE, cache).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}
        stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
        assert stored.count() == len(set(texts.values()))  # nothing is encoded twice, now or later


def test_token_cache_with_two_writers(spark, tmp_path):
    """Both saw a miss and both stored it: still one count for a row; counts that disagree are an error."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two words", "two words", None, ""])], "doc_id long, text string")
    cache, version = f"file://{tmp_path}/cache", token_counts.tokenizer_digest(PIECE)
    stored = token_counts.open_cache(spark, cache)
    for _ in range(2):
        token_counts.encode_counts(token_counts.misses(docs, stored.limit(0), version), PIECE, version).write.mode("append").parquet(cache)
    rows = token_counts.count(docs, PIECE, cache).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(i, len(library.encode(t or ""))) for i, t in enumerate(["one", "two words", "two words", None, ""])]
    assert spark.read.parquet(cache).count() == 6
    spark.read.parquet(cache).limit(1).withColumn("n_tokens", F.lit(99).cast("long")).write.mode("append").parquet(cache)
    with pytest.raises(Exception, match="two counts"):
        token_counts.count(docs, PIECE, cache).collect()


def test_token_counts_thinning_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([k % 5]) for k in range(50)] + [b"x"] * 9)], ["content_digest"])
    left = [r for b in token_counts.thinned(iter([batch])) for r in b.column(0).to_pylist()]
    assert set(left) == {*(bytes([k]) for k in range(5)), b"x"} and left.count(b"x") == 1
    ordered = pa.RecordBatch.from_arrays([pa.array(sorted(left))], ["content_digest"])
    assert [r for b in token_counts.first_of_each(iter([ordered, ordered.slice(50)])) for r in b.column(0).to_pylist()] == sorted(set(left))


def test_decontamination_by_brute_force(spark):
    rng = random.Random(9)
    words = ["one", "TWO", "drei", "été", "5", "x"]
    sentence = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(str(i), sentence(rng.choice([2, 3, 5, 11, 14]))) for i in range(25)] + [("n", None), ("e", "?!")]
    planted = [t for _, t in items if t]
    texts = [sentence(rng.randrange(30)) + rng.choice(planted).upper() + sentence(5) if rng.random() < 0.5 else sentence(40) for _ in range(150)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {i: {tuple(split(t)[k : k + 10]) for k in range(max(len(split(t)) - 9, min(1, len(split(t)))))} for i, t in items}
    docs, table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size in (decontaminate.BLOCK_BYTES, 600):  # one automaton, and several
        for r in decontaminate.find(docs, table, block_bytes=size).collect():
            w, hit, found = split(texts[r.doc_id]), set(), set()
            for i, ws in windows.items():
                for x in ws:
                    for k in range(len(w) - len(x) + 1):
                        if tuple(w[k : k + len(x)]) == x:
                            hit |= set(range(k, k + len(x)))
                            found.add(i)
            assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found))
            assert sum(len(split(texts[r.doc_id][s.start : s.end])) for s in r.spans) == len(hit)
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, table).collect()}
    assert clean == {r.doc_id for r in decontaminate.find(docs, table).where("n_hit = 0").collect()}
    assert decontaminate.report(docs, table.limit(0)).where("contaminated").count() == 0


def test_pii_surrogates(spark):
    text = "Mail Bob.Smith42@mail1.example.net or bob.smith42@MAIL1.example.net, call +1 (944) 555-6250; 42.144.35.254, 10.1.2.3, 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00. Mrs. Anna Müller met Herr Schmidt, and Dr Anna Müller left. Пишите иван@почта.example.org"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "clean 2024-01-15 v1.2 4111 1111 1111 1112"), (4, "Mr Anna"), (5, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.rewrite(docs, "k", found_col="found").collect()}
    assert rows[1].text == rows[2].text and rows[3].text == "clean 2024-01-15 v1.2 4111 1111 1111 1112" and rows[5].text is None
    before = pii.entities_of(text)
    after = rows[1].found
    assert [e.kind for e in after] == [e[2] for e in before] and len(before) >= 12
    for (a, b, kind, value, _), e in zip(before, after, strict=True):
        old, new = text[a:b], rows[1].text[e.start : e.end]
        assert new == e.value and new != old and value not in rows[1].text
        if kind in ("card", "iban", "phone"):
            assert [c.isalnum() for c in new] == [c.isalnum() for c in old] and pii.canonical(kind, new)
    by = [rows[1].text[e.start : e.end].lower() for e in after if e.kind == "name"]
    assert by[:2] == by[3:5] and by[2] not in by[:2]  # the same person, another person
    mails = [rows[1].text[e.start : e.end].lower() for e in after if e.kind == "email"]
    assert mails[0] == mails[1]
    private = next(rows[1].text[e.start : e.end] for e, x in zip(after, before, strict=True) if x[3] == "10.1.2.3")
    assert private.startswith("10.")


def test_pii_names_stay_one_person(spark):
    """Whole, bare and partial mentions, particles, both orders of a name in two documents."""
    texts = ["Mr John Smith came. John Smith left, said SMITH. Mr Smith's dog; John.", "Mrs. Mary Smith and Dr. Ana de la Cruz met Herr von Goethe. Goethe wrote to Cruz.", "Smith without a title, Goethe too"]
    rows = {r.doc_id: r.text for r in pii.rewrite(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    words = [re.findall(r"[^\W\d_]+", rows[i]) for i in range(3)]
    john, smith = words[0][1:3]
    assert rows[0] == f"Mr {john} {smith} came. {john} {smith} left, said {smith.upper()}. Mr {smith}'s dog; {john}."
    mary, ana, cruz, goethe = words[1][1], words[1][5], words[1][8], words[1][12]
    assert rows[1] == f"Mrs. {mary} {smith} and Dr. {ana} de la {cruz} met Herr von {goethe}. {goethe} wrote to {cruz}."
    assert len({john, smith, mary, ana, cruz, goethe, "John", "Smith", "Mary", "Ana", "Cruz", "Goethe"}) == 12
    assert rows[2] == texts[2]
    assert pii.surrogate("name", "john", "m", 0, "k") != pii.surrogate("name", "john", "m", 0, "other")


def test_pii_over_a_corpus_by_brute_force(spark, docs, texts):
    """One surrogate for an entity and one entity for a surrogate, none of them in the corpus; the rest as it was."""
    rows = {r.doc_id: r for r in pii.rewrite(docs, "k", found_col="found").collect()}
    one, back, values = {}, {}, set()
    for i, text in texts.items():
        before, after, new = pii.entities_of(text), rows[i].found, rows[i].text
        rest = [[t[a:b] for a, b in zip([0, *(x[1] for x in at)], [*(x[0] for x in at), len(t)], strict=True)] for t, at in ((text, [x[:2] for x in before]), (new, [(e.start, e.end) for e in after]))]
        assert rest[0] == rest[1] and len(before) == len(after)
        for (a, b, kind, value, _), e in zip(before, after, strict=True):
            shown = pii.canonical(kind, e.value)
            assert one.setdefault((kind, value), shown) == shown and back.setdefault((kind, shown), value) == value
            values.add((kind, value))
    assert len(one) > 10 and not values & set(back)


def test_pii_addresses_and_country_codes():
    found = lambda t: [(e[2], t[e[0] : e[1]]) for e in pii.entities_of(t)]
    assert found("x fe80::1, 2001:db8:85a3::8a2e:370:7334 at 10:30:45, std::vector a::b :: 1:2:3:4:5:6:7:8") == [("ip", x) for x in ("fe80::1", "2001:db8:85a3::8a2e:370:7334", "1:2:3:4:5:6:7:8")]
    assert found("иван@почта.рф, joe@münchen.de, a.b@xn--mnchen-3ya.de") == [("email", x) for x in ("иван@почта.рф", "joe@münchen.de", "a.b@xn--mnchen-3ya.de")]
    for phone, code in (("+33 6 12 34 56 78", "+33 "), ("0033 612345678", "0033 "), ("+49 (0)30 1234567", "+49 (0)"), ("+1 (944) 555-6250", "+1 ("), ("+351 912 345 678", "+351 ")):
        value = pii.canonical("phone", phone)
        new = pii.formatted("phone", phone, pii.surrogate("phone", value, "", 0, "k"))
        assert new.startswith(code) and new != phone and [c.isdigit() for c in new] == [c.isdigit() for c in phone]
    assert pii.canonical("phone", "+33 612345678") == pii.canonical("phone", "0033 612345678")
    for kind, value in (("ip", "8.8.8.8"), ("national", "123456789"), ("ip", "172.20.1.1")):
        assert pii.pool_of(kind, pii.permuted(kind, value, "k")) == pii.pool_of(kind, value)


def test_pii_kinds_and_what_is_left_alone():
    kinds = lambda t: [(e[2], t[e[0] : e[1]]) for e in pii.entities_of(t)]
    for phone in ("+33 6 12 34 56 78", "+19445556250", "(944) 555-6250", "944-555-6250", "+1 (017) 555-7713"):
        assert kinds(f"tel {phone}, ok") == [("phone", phone)]
    assert kinds("SSN 123-45-6789.") == [("national", "123-45-6789")]
    for clean in ("2024-01-15 10:30", "version 1.2.3.4.5", "pages 10-12", "4111111111111112", "a@b", "in 1999 2000 2001", "3.14159"):
        assert kinds(clean) == []


def test_pii_telephone_formats():
    found = lambda t: [t[e[0] : e[1]] for e in pii.entities_of(t) if e[2] == "phone"]
    for phone in ("+49 171 1234567", "+49 30 12345678", "+33 612345678", "+44 7700 900123", "(030) 1234567", "0171 1234567", "07700 900123", "01711234567", "0171 123 4567", "0800 555 1234", "1300 555 124", "030/1234567", "+49 (0)30 1234567", "0049 171 1234567", "(944) 5556250"):
        assert found(f"tel {phone}, ok") == found(phone) == [phone]
        assert found(f"on 2024-01-15 {phone}") == [phone]
        new = pii.formatted("phone", phone, pii.surrogate("phone", pii.canonical("phone", phone), "", 0, "k"))
        assert new != phone and [c.isdigit() for c in new] == [c.isdigit() for c in phone] and pii.canonical("phone", new)
    assert [e[2] for e in pii.entities_of("Des +1 (826) 555-4081 190.137.223.204 du")] == ["phone", "ip"]
    assert found("0171 1234567 030 7654321 x") == ["0171 1234567", "030 7654321"]
    for clean in ("1999-12-31 23", "31.12.1999 10", "1990-1995 2000", "id 1234567890", "0.1711234567", "from 1999 12345678", "(1999) 2345", "0012345678"):
        assert found(clean) == []


def test_pii_crowded_networks(spark):
    """More addresses of one private network than half of it, next to few of another."""
    values = [f"192.168.{k >> 8}.{k & 255}" for k in range(40_000)] + [f"10.0.0.{k}" for k in range(50)]
    made = pii.surrogate_map(spark.createDataFrame([("ip", v, "n") for v in values], "kind string, value string, gender string"), "k").collect()
    assert {r.value for r in made} == set(values) and len({r.surrogate for r in made}) == len(made) == len(values)
    assert all(r.surrogate != r.value and r.surrogate.split(".")[0] == r.value.split(".")[0] for r in made)
    assert all(r.surrogate.startswith("192.168.") for r in made if r.value[0:3] == "192")
    assert not {r.surrogate for r in made if r.value[:3] == "10."} & set(values)
    assert len({pii.surrogate("name", "ян", "n", k, "k") for k in range(3)}) == 3 and len(pii.surrogate("name", "ян", "n", 5, "k")) > 2


def test_pii_collisions_are_drawn_again(spark, monkeypatch):
    """With a generator that can't but collide at first, all surrogates end distinct and new."""
    entities = spark.createDataFrame([("ip", f"10.0.0.{k}", "n") for k in range(1, 120)], "kind string, value string, gender string")
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, gender, attempt, key: real(kind, value, gender, attempt, key) if attempt > 2 else f"10.0.0.{200 + attempt}")
    made = pii.surrogate_map(entities, "k").collect()
    assert len({r.value for r in made}) == len({r.surrogate for r in made}) == 119
    assert not {r.surrogate for r in made} & {r.value for r in made}


def test_licenses():
    join = lambda *names, by="\n": by.join(licenses.SENTENCES[n][0] for n in names)
    names = lambda t: [x[0] for x in licenses.licenses_of(t)[0]]
    assert names("Foo bar\nReleased under the MIT License.") == ["MIT"]
    assert names("x. Licensed under CC BY-NC 4.0. y") == ["CC-BY-NC-4.0"]
    assert names("This work is licenced under the GNU General Public Licence, version 3.") == ["GPL-3"]
    full = "The MIT License\n\nCopyright (c) 2020 Foo\n\n" + join("mit-grant", "mit-condition", "mit-as-is", "mit-liability", by="\n\n")
    assert licenses.licenses_of(full) == ([("MIT", 0, len(full))], [])
    bsd = join("bsd-intro", "bsd-source", "bsd-binary", by="\n\n")
    assert names(bsd) == ["BSD-2-Clause"] and names(bsd + ".\n\n" + join("bsd-endorse")) == ["BSD-3-Clause"]
    assert licenses.licenses_of(join("mit-as-is")) == ([], ["mit-as-is"])
    assert names("the license of a driver, all rights to be reserved later") == []
    for name, sentences in licenses.SENTENCES.items():
        for s in sentences:
            assert [i[3] for i in licenses.identifiers(s)] == [name], s
    for name, s in licenses.notices():
        assert [i[3] for i in licenses.identifiers(s + ".")] == [name], s
    assert names("This project is licensed under the MIT License - see the LICENSE file for details") == ["MIT"]
    assert names("// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode") == ["Apache-2.0 OR MIT"]
    assert licenses.licenses_of("It is released under the Foo Public License.") == ([], [licenses.UNKNOWN])


@pytest.mark.parametrize("gap", [2, 3])
def test_license_gap(gap, monkeypatch):
    monkeypatch.setattr(licenses, "GAP", gap)
    for n in range(5):
        text = licenses.SENTENCES["mit-grant"][0] + "\n\n" + "Something else here. " * n + "\n\n" + licenses.SENTENCES["mit-condition"][0]
        assert ([x[0] for x in licenses.licenses_of(text)[0]] == ["MIT"]) == (n <= gap)


def test_license_lines_by_brute_force():
    """The longest run of whole lines that is a known sentence, from each line on."""
    rng = random.Random(12)
    known = {" ".join(w for w, _ in licenses.words_of(s)): n for n, s in [*licenses.notices(), *((n, s) for n, ss in licenses.SENTENCES.items() for s in ss)]}

    def brute(lines):
        out, i = [], 0
        while i < len(lines):
            best = next((j for j in range(len(lines), i, -1) if " ".join(w for line in lines[i:j] for w, _ in licenses.words_of(line)) in known), None)
            if best:
                out.append(known[" ".join(w for line in lines[i:best] for w, _ in licenses.words_of(line))])
            i = best or i + 1
        return out

    pieces = [s for n in ("mit-grant", "bsd-source", "gpl-later", "apache-may") for s in licenses.SENTENCES[n]] + ["Licensed under the MIT License", "some words of the license", "all"]
    for _ in range(300):
        words = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))).replace(".", "").replace(":", "").split(" ")
        lines, k = [], 0
        while k < len(words):
            n = rng.choice([1, 3, 8, 200])
            lines.append(" ".join(words[k : k + n]))
            k += n
        text = "\n".join(x for line in lines for x in ([line, "---"] if rng.random() < 0.2 else [line]))
        assert [i[3] for i in licenses.identifiers(text) if i[3] != licenses.UNKNOWN] == brute(lines)


def test_licenses_of_long_texts():
    for text in ("licence\n" + "---\n" * 50_000, "licence " + "." * 50_000 + "x", "licensed under " * 20_000, "licensed under the\n" * 20_000):
        start = time.perf_counter()
        licenses.licenses_of(text)
        assert time.perf_counter() - start < 3


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: bpe.roundtrip_digests(d, BPE),
        simhash.report,
        licenses.report,
        language.report,
        minhash.edited_report,
        secrets.report,
        lambda d: toxicity.report(d, d.select("doc_id", F.lit(1).alias("toxic"))),
        lambda d: token_counts.report(d, PIECE),
        lambda d: decontaminate.report(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        lambda d: pii.report(d, "k"),
    ],
    ids=["bpe", "simhash", "licenses", "language", "minhash", "secrets", "toxicity", "token_counts", "decontaminate", "pii"],
)
def test_awkward_and_empty_tables(apply, awkward, empty):
    rows = apply(awkward).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in awkward.collect())
    again = apply(awkward).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert apply(empty).collect() == []


def test_pipeline(spark, docs, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.find(docs, items).where("n_hit > 0").collect()}
    assert {r.doc_id for r in rows} == {i for i in kept - dirty if any(c.isalpha() for c in texts[i])}
    library = tokenizers.Tokenizer.from_file(BPE)
    for r in rows:
        decoded = library.decode(r.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        if not pii.entities_of(texts[r.doc_id]):
            assert decoded == texts[r.doc_id]


LONG, SIX = "lorem ipsum dolor sit amet consectetur " * 12_000, "One two three four five six."


def test_values_on_awkward_tables(awkward):
    """What the docstrings say of null, empty, blank, letterless, very long and repeated texts."""
    of = lambda df, i: sorted((r for r in df.collect() if r.doc_id == i), key=str)
    library, piece = tokenizers.Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    nothing = hashlib.sha256(b"").hexdigest()
    out = bpe.roundtrip_digests(awkward, BPE)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, nothing, nothing) for i in (1, 2) for r in of(out, i))
    assert of(out, 5)[0].n_tokens == len(library.encode(LONG, add_special_tokens=False).ids) and of(out, 5)[0].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert len(of(out, 6)) == 3 and of(out, 8)[0].ids_sha256 in {r.ids_sha256 for r in of(out, 6)}
    out = simhash.report(awkward)
    assert {(r.fingerprint, r.component_id) for i in (1, 2, 3) for r in of(out, i)} == {("0" * 16, 1)} and of(out, None)[0].fingerprint in ("0" * 16, f"{fingerprint('no id at all here'):016x}")
    assert of(out, 8)[0].component_id == 6 and of(out, 5)[0].fingerprint == f"{fingerprint(LONG):016x}"
    out = licenses.report(awkward)
    assert {(r.licenses, r.n_passages, r.spans, r.loose) for r in out.collect()} == {("", 0, "", "")}
    out = language.report(awkward)
    assert {(r.lang_pred, r.score) for i in (1, 2, 3, 4) for r in of(out, i)} == {("und", 0.0)} and {r.lang_pred for i in (5, 6, 7, 8) for r in of(out, i)} == {"en"}
    out = minhash.edited_report(awkward)
    assert of(out, 1)[0].n_chars == 0 and set(of(out, 1)[0].fingerprint) == {"0"} and of(out, 5)[0].n_chars == len(LONG)
    assert len({r.fingerprint for i in (6, 8) for r in of(out, i)}) == 2 and of(out, 1)[0].near_edited == 1.0
    out = secrets.report(awkward)
    assert {(r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out.collect()} == {(0, 0, 0, nothing, "")}
    out = toxicity.report(awkward, awkward.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert {(r.score < 0.1, r.predicted) for r in out.collect()} == {(True, 0)}
    out = token_counts.report(awkward, PIECE)
    assert of(out, 1)[0][1:] == of(out, 2)[0][1:] == (0, 0, False) and of(out, 5)[0][1:] == (len(LONG), len(piece.encode(LONG)), True)
    out = decontaminate.report(awkward, awkward.where("doc_id = 8").select(F.col("doc_id").alias("item_id"), "text"))
    assert of(out, 1)[0][1:] == (0, 0, 0, nothing, False) and of(out, 8)[0][1:] == (6, 6, 1, hashlib.sha256(b"8").hexdigest(), True) and [r.n_hit for r in of(out, 6)].count(6) == 2 and of(out, 5)[0][1:] == (72_000, 0, 0, nothing, False)
    out = pii.report(awkward, "k")
    assert of(out, 1)[0].text == "" and of(out, 5)[0].text == LONG and {r.n_entities for r in out.collect()} == {0}


def test_tables_are_deleted(spark, docs):
    """Those of a scratch but the one kept; those released; without a shared folder only a local session works."""
    from tidewater.llm import common

    before = set(common._PATHS)
    with common.scratch(spark) as kept:
        kept.append(common.materialise(simhash.keep_one(docs), "kept"))
    assert len(common._PATHS - before) == 1 and kept[0].count() > 0
    common.release(kept[0])
    assert common._PATHS == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ"):
        spark.read.parquet(kept[0].inputFiles()[0]).count()
    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(elsewhere)


def test_pipeline_stages_on_awkward_tables(spark, awkward, empty, docs):
    import corpus_pipeline

    for table in (awkward, empty):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            if name != "tokens":
                assert out.columns == table.columns
        assert out.count() <= table.count()
