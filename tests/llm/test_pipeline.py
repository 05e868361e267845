"""Each pipeline stage, on what the one before it kept, against plain code."""

import itertools
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
import sentencepiece
import zstandard

import corpus_pipeline
from inkwell.llm import langid, mixing, pieces, secrets

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return list(dict.fromkeys(re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower()))))


def plain_language(text, ranked):
    """(language, margin) with compressors and dictionaries made anew for every text."""
    words = plain_words(text)
    if not words:
        return "und", 0.0
    shown = "\n".join(words).encode()

    def content(lang, most):
        taken, size = [], 0
        for w in ranked[lang]:
            size += len(w.encode()) + 1
            if size > most:
                break
            taken.insert(0, w)
        return ("\n".join(taken) + "\n").encode()

    def size_of(data, lang, most, level):
        held = zstandard.ZstdCompressionDict(content(lang, most), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False).compress(data))

    def margin(sizes):
        best, second = sorted(sizes.values())[:2]
        return (second - best) / second

    sizes = {lang: size_of(shown, lang, *langid.DICTIONARIES[0]) for lang in sorted(ranked)}
    if margin(sizes) < langid.CLOSE:
        for most, level in langid.DICTIONARIES[1:]:
            for lang in sizes:
                lead = content(lang, most)[-langid.LEAD :] + b"\n"
                sizes[lang] += size_of(lead + shown + b"\n", lang, most, level) - size_of(lead, lang, most, level)
    return min(sizes, key=sizes.get), margin(sizes)


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def learned(spark):
    return langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def ranked(learned):
    return learned[0]


def test_margin_rejects_only_where_most_are_wrong(learned):
    assert langid.MIN_MARGIN <= learned[1] <= langid.MOST_MARGIN
    assert langid.least_margin([]) == langid.least_margin([(0.002, True)] * 9) == langid.least_margin([(0.002, False)] * 4) == langid.MIN_MARGIN
    told = [(0.0, False), (0.0, False), (0.001, True), (0.002, False), (0.003, False), (0.004, True), (0.9, False)]
    assert 0.003 < langid.least_margin(told) < 0.0031 and langid.least_margin([(0.2, False)] * 9) == langid.MIN_MARGIN


def test_training_words_are_those_of_whole_texts(spark, documents, ranked):
    """Fewer texts than the sample holds: words by the number of distinct texts that have them."""
    import zlib

    fit = {(d["lang"], d["text"]) for d in documents if d["lang"] and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1}
    for lang, words in ranked.items():
        seen = Counter(w for held, text in fit if held == lang for w in plain_words(text))
        assert words == sorted(seen, key=lambda w: (-seen[w], w.encode()))[: len(words)] and len(words) > 100


def test_prediction_is_that_of_plain_compressors(spark, documents, ranked):
    """Whole documents, their first words only, and texts without a letter."""
    few = documents[:40]
    shown = [d["text"] for d in few] + [" ".join((d["text"] or "").split()[:n]) for d in few for n in (1, 2, 4)] + ["½ ² Ⅷ 12 _", "", None, "x²"]
    df = spark.createDataFrame(list(enumerate(shown)), "doc_id long, text string")
    for r in langid.identify(df, ranked, ["doc_id"]).collect():
        lang, margin = plain_language(shown[r.doc_id], ranked)
        assert (r.lang_pred, r.accepted) == (lang, lang != "und" and margin >= langid.MIN_MARGIN) and abs(r.score - margin) < 1e-12


def test_stages_against_plain_code(spark, documents, ranked, learned):
    docs, held = spark.read.parquet(f"{SF}/documents.parquet"), documents
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "secret_scan", "mixing", "pieces"]

    def through(name):
        nonlocal docs
        docs = stages[name](spark, docs, SF).checkpoint()
        return [r.asDict() for r in docs.collect()]

    identified = through("language_id")
    accepted = [d for d in held if (found := plain_language(d["text"], ranked))[0] != "und" and found[1] >= learned[1]]
    assert sorted(identified, key=str) == sorted(accepted, key=str) and len(identified) > 0.9 * len(held)

    kept = through("near_duplicates")
    sets = {}
    for d in identified:
        words = d["text"].encode().lower().split()
        sets[d["doc_id"]] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert sorted(d["doc_id"] for d in kept) == sorted(i for i in sets if root(i) == i) and len(kept) < len(identified)

    clean = {d["doc_id"]: d for d in through("secret_scan")}
    key = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I)
    for d in kept:
        now = clean[d["doc_id"]]
        bad = key.search(d["text"]) or re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", d["text"])
        assert now["n_chars"] == len(now["text"]) and not key.search(now["text"]) and not re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", now["text"])
        assert (now["text"] != d["text"]) >= bool(bad)
        if not secrets.Scanner(secrets.BASE + secrets.MORE).scan([d["text"]], [d["text"].encode()])[0]:
            assert now == d
    assert len(clean) == len(kept)

    mixed = through("mixing")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for i, d in clean.items()}
    source = {i: d["source"] for i, d in clean.items()}
    sizes = Counter()
    for i in size:
        sizes[source[i]] += size[i]
    taken, times = Counter(), Counter(d["doc_id"] for d in mixed)
    for i, n in times.items():
        assert n <= mixing.PASSES and size[i] > 0
        taken[source[i]] += n * size[i]
    for s, target in mixing.targets(dict(sizes)).items():
        largest = max(size[i] for i in size if source[i] == s)
        assert abs(taken[s] - target) <= largest / 2 + 1

    encoded = through("pieces")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    encoder = pieces.Encoder(pieces.Vocabulary.read(pieces.MODEL_FILE))
    assert Counter(d["doc_id"] for d in encoded) == times
    for d in encoded:
        text = clean[d["doc_id"]]["text"]
        assert d["round_trip"] and d["n_tokens"] == len(d["ids"]) and encoder.decode([d["ids"]])[0] == text
        if "  " not in text and "\n" not in text and "▁" not in text:
            assert model.decode(list(map(int, d["ids"]))) == text
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole) == sorted((d["doc_id"], tuple(d["ids"])) for d in encoded)


def test_finished_checkpoints_are_deleted(spark):
    from inkwell.llm import common

    df = common.cut(spark.range(5))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(place)
    common.let_go(df)
    assert not files.exists(place)
