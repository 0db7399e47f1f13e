import hashlib

import pytest

import corpus_pipeline
from lettermill.llm import bpe, decontaminate, near_dedup, pii

ITEM = " ".join(f"item{i} word" for i in range(12))
PLAIN = "A quiet morning came over the hills. " + " ".join(f"then step{i} went on." for i in range(12))
TOXIC = "you are scum and trash, a stupid idiot"


@pytest.fixture(scope="module")
def texts():
    """Seven rows by hand, then labelled ones from which toxic words are learned, then odd ones."""
    own = [PLAIN, PLAIN, PLAIN + " more", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!", f"Here it is. {ITEM}. The end of it.", "Write to me at ab@cd.org about this plan.", TOXIC]
    own += [f"Oh name{i}, {TOXIC} of place{i}." for i in range(6)]
    own += [f"Clean thing{i} goes home{i} by road{i}. It rests there{i}." for i in range(40)]
    own += [None, "", " \n", "word " * 3000, PLAIN + " " + " ".join(f"far{i} away." for i in range(4000))]
    return own


def expected(kept, texts):
    """Rows of the last stage for what the classifier keeps, by brute force."""
    import public_tokenizers as P
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    groups = near_dedup.brute({i: texts[i] for i in kept})
    out = set()
    for i in kept:
        n, hit, _ = decontaminate.brute(texts[i], [("1", ITEM)])
        if groups[i][1] != i or hit and 20 * hit >= n:
            continue
        text = texts[i]
        for a, kind, b in sorted(pii.brute(text), reverse=True):
            text = text[:a] + f"<{pii.KINDS[kind].upper()}>" + text[b:]
        ids = library.encode_ordinary(text)
        out.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_stages_take_effect(spark, docs_of, folder, texts):
    labels = spark.createDataFrame([(i, 1, int(TOXIC in (t or ""))) for i, t in enumerate(texts) if i > 6], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = docs_of(texts)
    path = folder(documents=docs, labels=labels, benchmark=bench)
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == docs.columns
        seen.append(sorted(r["doc_id"] for r in now.collect()))
    assert [[i for i in ids if i < 7] for ids in seen] == [[0, 1, 2, 4, 5], [0, 4, 5], [0, 5], [0, 5]]
    assert not [i for i in seen[0] if texts[i] is None or not texts[i].strip() or TOXIC in texts[i]]
    assert set(range(13, 53)) <= set(seen[-1])
    kept = {r["doc_id"]: r for r in now.collect()}
    assert kept[5]["text"] == "Write to me at <EMAIL> about this plan." and kept[5]["n_chars"] == len(kept[5]["text"])
    rows = corpus_pipeline.run(spark, path).collect()
    assert {tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in rows} == expected(seen[0], texts)
    assert len(rows) == len(seen[-1])


def test_null_and_repeated_ids_and_no_rows(spark, docs_of, folder):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    a, b = (" ".join(f"{x}{i} went on." for i in range(30)) for x in "ab")
    path = folder(documents=docs_of([(1, a), (1, a), (5, a), (5, b), (None, b), (None, None)]), labels=labels, benchmark=bench)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()) == [1, 5]
    path = folder(documents=docs_of([]), labels=labels, benchmark=bench)
    assert corpus_pipeline.run(spark, path).count() == 0
