"""Operators that judge each row on its own, against brute force."""

import base64
import hashlib
import random
import struct
import weakref
import zlib

import pytest

from lettermill.llm import bpe, common, decontaminate, media, sharding, url_filter

WORDS = "alpha beta gamma delta eps zeta eta theta".split()


def test_sharding_law_and_places(spark, docs_of):
    texts = ["x" * (i * 37 % 500) for i in range(400)] + [None, "", "é" * 40, None]
    docs = docs_of(texts).unionAll(docs_of([(None, "n"), (5, "again"), (5, "again")]))
    rows = sharding.shard_table(docs, slots=512).collect()
    assert len(rows) == 407
    load, places = [0] * 16, {}
    for r in rows:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(load) - min(load) <= 500
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by = {r["doc_id"]: r for r in rows}
    assert by[402]["size"] == 81 and by[402]["text_crc32"] == zlib.crc32(("é" * 40).encode())
    assert by[400]["size"] == 1 and by[400]["text_crc32"] == 0


def test_sharding_empty_table(docs_of):
    assert sharding.shard_table(docs_of([]), slots=64).count() == 0


def test_sharding_on_a_stored_map(spark, docs_of, tmp_path):
    """The latest map is edited, versions are added, and few rows move."""
    path = f"file://{tmp_path}/map"
    texts = ["x" * (i * 37 % 500) for i in range(600)]
    place = lambda docs, shards: {r["doc_id"]: r["shard"] for r in sharding.shard_table(docs, shards=shards, slots=256, path=path).collect()}
    assert sharding.latest_version(spark, path) is None
    first = place(docs_of(texts), 8)
    assert sharding.latest_version(spark, path) == 1
    assert place(docs_of(texts), 8) == first and sharding.latest_version(spark, path) == 1
    more = place(docs_of(texts + ["y" * 50] * 20), 8)
    assert sharding.latest_version(spark, path) == 2 and sum(more[i] != first[i] for i in first) < 300
    assert set(place(docs_of(texts), 9).values()) == set(range(9))
    assert set(place(docs_of(texts), 5).values()) == set(range(5))


def test_sharding_query_and_a_hot_row(spark, docs_of, folder):
    rows = sharding.query(spark, folder(documents=docs_of([(1, "same")] * 300 + [(i, "t" * i) for i in range(2, 200)]))).collect()
    places, load = {}, [0] * 16
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert len(rows) == 498 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalance_edits_few_slots_and_fills_new_shard():
    random.seed(3)
    sizes = {s: random.randrange(1, 1000) for s in range(256)}
    first = sharding.rebalance(sharding.first_map(256, 4), sizes, 4)
    load = [sum(n for s, n in sizes.items() if first[s] == k) for k in range(4)]
    assert max(load) - min(load) <= 2
    grown = sharding.rebalance(first, sizes, 5, within=0.05)
    load = [sum(n for s, n in sizes.items() if grown[s] == k) for k in range(5)]
    assert max(load) - min(load) <= 0.06 * sum(load) / 5
    assert sum(a != b for a, b in zip(first, grown)) < 128


def test_map_versions(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.write_map(spark, path, 0, [0, 1])
    sharding.write_map(spark, path, 1, [1, 1])
    assert [r["shard"] for r in sharding.read_map(spark, path, 0).orderBy("virtual_slot").collect()] == [0, 1]


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filter(spark):
    urls = [None, "", "x", "http://", "http://A.Example.NET/en/x?q#f", "http://example.net/en", "//net/", "a://net", "a://net/", "a://b.net?x/y", "https://x.org/fr/", "https://X.org/fr", "s://u@x.example.com:80/de/", "s://x.example.com/de/a/b#/c", "s://notexample.com/de/", "a://b://c.net/", "s://" + "a." * 3000 + "net/" + "b/" * 2000, "http://é.NET/É", "s://x.net\n/a\n/b"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(3, urls[4], "h", 1)] * 2, "page_id long, url string, html string, verdict int")
    rows = url_filter.judge(pages, url_filter.rules_table(spark)).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        url = urls[4] if r["page_id"] == 3 and r["host"] else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(url), url


def test_url_rules_without_last_slash_and_no_rules(spark):
    pages = spark.createDataFrame([(0, "s://a.b/xyz/q"), (1, "s://a.b/x"), (2, "s://b")], "page_id long, url string")
    rows = url_filter.judge(pages, url_filter.rules_table(spark, [("b", "/xy", "block"), ("b", "", "block"), ("a.b", "/x", "allow")])).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["a.b/x", "a.b/x", "b"]
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rules_table(spark, [])).collect()} == {"allow"}


def test_media_round_trip(docs_of):
    payloads = [b"", b"x", b"y" * 192, b"z" * 193, bytes(range(256)) * 40]
    for raw in payloads:
        stored = media.pack(media.pad(raw))
        found = media.info(stored)
        assert media.read_samples(stored) == media.pad(raw)
        assert found["codec"] == "raw " and found["samples"] == found["duration"] == len(media.pad(raw)) // 192
        assert [stored[k["offset"] : k["offset"] + k["length"]] for k in found["keyframes"]] == [media.pad(raw)[i : i + 192] for i in range(0, len(media.pad(raw)), 192 * 8)]
    assert media.info(None) is None and media.info(b"") is None and media.info(b"\0\0\0\x20moovxxxx") is None and media.info(b"junk" * 9) is None


def test_media_other_layouts():
    stored = media.pack(media.pad(b"a" * 3000))
    wide = stored.replace(b"stss", b"free")  # without a table of keyframes every sample is one
    assert len(media.info(wide)["keyframes"]) == 16
    far = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8)  # a 64-bit size before the rest
    assert media.tracks(far + stored)[0].codec == "raw "


def test_media_hostile_containers():
    """Anything gives null or a result, in bounded time and memory."""
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    assert media.info(nested) is None
    stored = media.pack(media.pad(b"a" * 3000))
    at = stored.index(b"stsz") + 8
    assert media.info(stored[:at] + struct.pack(">II", 1, (1 << 32) - 1) + stored[at + 8 :]) is None
    at = stored.index(b"stsc") + 12
    assert media.info(stored[:at] + struct.pack(">I", 0) + stored[at + 4 :]) is None
    random.seed(8)
    for _ in range(3000):
        raw = bytearray(stored[:900])
        for _ in range(random.randrange(1, 5)):
            raw[random.randrange(len(raw))] = random.randrange(256)
        media.info(bytes(raw + stored[900:])[: random.choice((len(stored), random.randrange(900)))])


def test_media_query(spark, docs_of, folder):
    texts = [None, "", "abc", "é" * 500, "x" * 192, "abc"]
    rows = media.query(spark, folder(documents=docs_of(texts))).collect()
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == media.brute(texts[r["doc_id"]])
    assert len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in rows if r["doc_id"] in (2, 5)}) == 1


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(P.path(bpe.VOCABULARY))
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(public):
    ranks, pattern, library = public
    encoder = bpe.Encoder(ranks, pattern)
    random.seed(1)
    pool = ["a", "B", "the", "ing", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u0085", "\x1c", "é", "ß", "1", "²", "½", "Ⅷ", "一", "'s", "'ll", "'", "!!", "$", "<|endoftext|>", "😀", "\u200d", "ñ", "\u2003", "x" * 70, "ab" * 40]
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randrange(30)))
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), repr(text)
    for text in ("a" * 20_000, "ab " * 9000, "é" * 5000, " " * 3000 + "x", "\n \n" * 500):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_forgets(public, monkeypatch):
    ranks, pattern, library = public
    monkeypatch.setattr(bpe, "PIECES", 5)
    monkeypatch.setattr(bpe, "WORDS", 3)
    encoder = bpe.Encoder(ranks, pattern)
    for k in range(5):
        text = " ".join(f"w{i}qz{k}" for i in range(40)) + " " + "long" * 30
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_merges_side_by_side(public, monkeypatch):
    """Words that come once each are not merged one by one, which was nearly all of the time."""
    ranks, pattern, library = public
    alone = []
    monkeypatch.setattr(bpe, "merge", lambda piece, *a, f=bpe.merge: alone.append(piece) or f(piece, *a))
    random.seed(2)
    syllables = ["th", "en", "er", "ß", "ö", "q", "zx", "kj", "一", "é", "ing"]
    words = ["".join(random.choices(syllables, k=random.choice((3, 5, 9, 14)))) for _ in range(4000)]
    words += ["".join(random.choices("abcxyz", k=random.randrange(65, 600))) for _ in range(400)]
    random.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    ids = bpe.id_lists(texts, bpe.Encoder(ranks, pattern)).to_pylist()
    assert ids == [library.encode_ordinary(x) for x in texts]
    assert len(alone) < 320, len(alone)


def test_bpe_white_space_around_words(public):
    import regex

    ranks, pattern, library = public
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() or regex.match(r"\s", chr(c))]
    encoder = bpe.Encoder(ranks, pattern)
    texts = [f"x {y} z{c}w 's{c}{c} " for c in spaces for y in (c, f"a{c}", f"{c}b", f"a{c}b", f"!{c}\x0b", f"一{c}二", "")]
    assert bpe.id_lists(texts, encoder).to_pylist() == [library.encode_ordinary(x) for x in texts]
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice([*spaces, " ", " ", "a", "b!", "'t", "七"]) for _ in range(60))
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_bpe_byte_not_in_vocabulary():
    ranks = {b"a": 0, b"b": 1, b" ": 2, b"ab": 3}
    encoder = bpe.Encoder(ranks, r" ?[a-z]+")
    words = ["".join("ab"[int(c)] for c in f"{i:07b}") for i in range(100)]
    pieces = [words[0], *(" " + w for w in words[1:])]
    assert encoder.encode(" ".join(words)).tolist() == [x for p in pieces for x in bpe.merge(p.encode(), ranks, bpe.pair_table(ranks))]
    for text in ("abc", " ".join(w + "c" for w in words)):
        with pytest.raises(KeyError):
            encoder.encode(text)
    assert encoder.encode("ab ab").tolist() == [3, 2, 3]  # a failure leaves nothing wrong behind


def test_bpe_query(spark, docs_of, folder, public):
    texts = [None, "", "Hello  world\n it's 3 ½", "é" * 300, "a b"]
    for r in bpe.query(spark, folder(documents=docs_of(texts))).collect():
        text = texts[r["doc_id"]] or ""
        ids = public[2].encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_decode(spark, public):
    ranks = public[0]
    rows = [(1, [0, 50255, 7]), (2, []), (3, None), (4, [11])]
    got = bpe.decode_column(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    tokens = {v: k for k, v in ranks.items()}
    assert {r["doc_id"]: r["decoded"] for r in got} == {1: tokens[0] + tokens[50255] + tokens[7], 2: b"", 3: None, 4: tokens[11]}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_column(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")).collect()


def test_bpe_small_vocabulary(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258}
    path = tmp_path / "v"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    assert bpe.load_ranks(str(path)) == ranks
    pairs = bpe.pair_table(ranks)
    assert bpe.merge(b"aaaaa", ranks, pairs) == [256, 257]
    assert bpe.merge(b"baa", ranks, pairs) == [98, 256]


def case(seed, window=13):
    rnd = random.Random(seed)
    some = lambda n: " ".join(rnd.choice(WORDS[: rnd.choice((2, 3, 8))]) for _ in range(n))
    items = [(str(i), some(rnd.choice((0, 1, 3, 8, 12, 13, 14, 20, 40)))) for i in range(rnd.randrange(1, 7))]
    texts = []
    for _ in range(8):
        text = some(rnd.randrange(40))
        for _ in range(rnd.randrange(3)):
            own = rnd.choice(items)[1].split()
            a = rnd.randrange(len(own) + 1)
            text += ". " + " ".join(own[a : a + rnd.randrange(30)]) + ", odd " + some(3)
        texts.append(text)
    return items, texts


@pytest.mark.parametrize("seed", range(150))
def test_automaton_equals_brute(seed):
    window = 13 if seed % 2 else 4
    items, texts = case(seed)
    automaton = decontaminate.Automaton([(a, decontaminate.words(b)) for a, b in items], window)
    for text in texts:
        own = decontaminate.words(text)
        spans, numbers = automaton.match(own)
        got = (len(own), sum(b - a for a, b in spans), sorted({automaton.names[x] for x in numbers}))
        assert got == decontaminate.brute(text, items, window)
        assert spans == decontaminate.joined(spans)


def test_decontaminate_query_and_blocks(spark, docs_of, folder):
    items, texts = case(5)
    texts += [None, "", "ÀB c" + " alpha" * 60]
    bench = spark.createDataFrame([(int(a), b) for a, b in items] + [(90, None), (91, items[0][1])], "item_id long, text string")
    rows = decontaminate.query(spark, folder(documents=docs_of(texts), benchmark=bench)).collect()
    named = [*items, ("90", None), ("91", items[0][1])]
    for r in rows:
        n, hit, names = decontaminate.brute(texts[r["doc_id"]], named)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    blocks = decontaminate.match_column(docs_of(texts), bench, block_words=20).collect()
    for r in blocks:
        n, hit, names = decontaminate.brute(texts[r["doc_id"]], named)
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), r["hit_items"]) == (n, hit, names)
    assert decontaminate.match_column(docs_of(texts), bench.limit(0)).where("size(hit_spans) > 0").count() == 0


def test_decontaminate_ids_and_clashing_names(spark, docs_of):
    """An id that is empty is an id; none is not listed. The same in one block and in several."""
    texts = [" ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20)), "x"]
    bench = spark.createDataFrame([("", texts[0]), (None, texts[1])], "item_id string, text string")
    docs = docs_of(texts).selectExpr("*", "'mine' AS N_words", "3 AS row")
    for size in (decontaminate.BLOCK_WORDS, 15):
        out = decontaminate.match_column(docs, bench, block_words=size)
        assert out.columns == [c for c in docs.columns if c != "N_words"] + ["n_words", "hit_spans", "hit_items"]
        assert {r["doc_id"]: (r["n_words"], r["hit_items"], len(r["hit_spans"]), r["row"]) for r in out.collect()} == {0: (20, [""], 1, 3), 1: (20, [], 1, 3), 2: (1, [], 0, 3)}


def test_cut_and_remove(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of([f"É start, {item}. end!", "clean text", None, item + " pad" * 400])
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, bench, longest=10).collect()}
    assert cut == {0: "É start, . end!", 1: "clean text", 2: None, 3: " pad" * 400}


def test_what_a_worker_keeps_is_freed_at_the_next_stage():
    class Owner:
        def __init__(self):
            self.ask = lambda: self

    seen = weakref.ref(common.kept(("owner",), Owner))
    assert seen() is common.kept(("owner",), Owner)
    common._drop_kept()
    assert seen() is None


def test_decontamination_with_one_item_above_a_block(spark, docs_of, monkeypatch):
    """A long item is cut, equal items are spread, and no automaton gets much more than a block."""
    rnd = random.Random(12)
    long = [f"L{rnd.randrange(400)}" for _ in range(900)]
    texts = [" ".join(long[a : a + n]) for a, n in ((0, 900), (95, 13), (88, 40), (399, 12), (700, 200), (887, 13))] + ["none of it", None, "short Item here"]
    items = [("9", " ".join(long)), *[(str(100 + i), " ".join(long[50:70])) for i in range(30)], ("5", "SHORT item"), ("6", None), ("7", "!")]
    sizes = []
    real = decontaminate._marked

    def watched(docs, block, window):
        sizes.append(sum(len(decontaminate.words(r["text"])) for r in block.collect()))
        return real(docs, block, window)

    monkeypatch.setattr(decontaminate, "_marked", watched)
    bench = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    rows = {r["doc_id"]: r for r in decontaminate.match_column(docs_of(texts), bench, block_words=200).collect()}
    for i, text in enumerate(texts):
        n, hit, names = decontaminate.brute(text, items)
        assert (rows[i]["n_words"], sum(s["end"] - s["start"] for s in rows[i]["hit_spans"]), rows[i]["hit_items"]) == (n, hit, names)
    assert len(sizes) >= 6 and max(sizes) <= 200 + 33


def test_unpacking_hostile_media(spark):
    """Nulls, junk, cut containers and samples outside the file give null, and nothing fails."""
    stored = media.pack(media.pad(b"payload " * 400))
    chunks = stored.index(b"stco") + 12
    outside = stored[:chunks] + struct.pack(">I", len(stored)) + stored[chunks + 4 :]
    rows = [(0, stored), (1, None), (2, b""), (3, b"junk"), (4, stored[:-200]), (5, stored[:300]), (6, outside), (7, b"\0\0\0\x08moov"), (8, stored)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id int, media binary, Payload string")
    got = {r["id"]: r["payload"] for r in media.unpack_column(df).collect()}
    assert got[0] == got[8] == media.pad(b"payload " * 400) and all(got[i] is None for i in range(1, 8)) and len(got) == 9
    assert media.unpack_column(df.where("false")).count() == 0
