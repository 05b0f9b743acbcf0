"""Token ids and SentencePiece: exact round trips, and brute force for the Viterbi pass."""

import random
import zlib

import numpy as np
import pytest

from leadloom.llm import dac, sentencepiece_viterbi, token_ids
from leadloom.llm.queries import PIECE_BPE as PIECES
from leadloom.llm.queries import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long"
TEXTS = ["", None, " ", "the cat sat", "a\n\n  b\tc ", "it's I'LL x\x1cy \x85z", "Ünïcödé ▁ ▁▁ 字漢 🙂", "x" * 5000, "ab" * 40_000 + " end", "<|startoftext|> a<|endoftext|>", " lead  trail  "]


def test_block_gives_any_token():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice(np.array([0, 1, 255, 256, 49407, 65535, 65536, 2**31, 2**32 - 1], np.uint32), n)
        cuts = np.sort(rng.integers(0, n + 1, 4))
        starts = np.concatenate([[0], cuts, [n]])
        block = dac.Block(dac.pack([5, None, -3, 2**62, 9], starts, ids))
        assert block.doc_ids == [5, None, -3, 2**62, 9]
        assert [block.get(i) for i in range(n)] == ids.tolist()
        for k in range(5):
            assert block.document(k).tolist() == ids[starts[k] : starts[k + 1]].tolist()
    with pytest.raises(ValueError):
        dac.Block(b"\0" * 64)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = [(k * 7 % 11 - 3, t, "en", "s", 1, 2) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None), (4, "twice", None, None, None, None), (4, "again", None, None, None, None)]
    token_ids.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/ids", WORD_BPE, block_ids=500)
    found = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_ids.read(spark, f"file://{tmp_path}/ids").collect()}
    wanted, at = {}, 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        wanted[doc_id, at] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert found == wanted


def test_token_files_of_no_rows(spark, tmp_path):
    token_ids.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/ids", WORD_BPE)
    assert token_ids.read(spark, f"file://{tmp_path}/ids").count() == 0


def whole_text_score(pieces, text):
    """The best sum of scores by dynamic programming over the whole text, without a window."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in pieces.scores:
                best[end] = max(best[end], best[start] + pieces.scores[text[start:end]][0])
        best[end] = max(best[end], best[end - 1] + pieces.byte_score * len(text[end - 1].encode()))
    return best[-1]


def test_viterbi_is_optimal_and_round_trips():
    pieces, rng = sentencepiece_viterbi.Pieces(PIECES), random.Random(2)
    score = {k: s for s, k in pieces.scores.values()}
    for _ in range(150):
        text = "".join(rng.choice(["the", "ing", "er", " ", "  ", "\n", "x", "é", "▁", "字", "🙂", "antidis", "."]) for _ in range(rng.randint(1, 25)))
        ids = pieces.encode(text)
        assert pieces.decode(ids) == text
        assert sum(score.get(k, pieces.byte_score) for k in ids) == pytest.approx(whole_text_score(pieces, " " + text))


def test_viterbi_commits_before_the_end():
    pieces = sentencepiece_viterbi.Pieces(PIECES)
    parts = list(pieces.stream("thequickbrownfox" * 200))
    assert len(parts) > 20 and max(map(len, parts)) < 100
    assert pieces.decode([1, *(x for p in parts for x in p)]) == ("thequickbrownfox" * 200)[1:]


def test_sentencepiece_rows(spark):
    rows = [(k, t, None, None, None, None) for k, t in enumerate(TEXTS)] + [(3, "the cat sat", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sentencepiece_viterbi.encode(docs, PIECES, keep=("doc_id", "text", "start")).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    assert {r.doc_id for r in found if not r.ids} == {0, 1}
    assert all(r.round_trip for r in sentencepiece_viterbi.digests(docs, PIECES).collect())
    assert sentencepiece_viterbi.encode(docs.limit(0), PIECES).count() == 0


def test_checksums_read_a_block_once():
    import zlib

    rng = np.random.default_rng(5)
    starts = np.array([0, 0, 3, 1500, 1501, 4000])
    ids = rng.integers(0, 1 << 18, starts[-1]).astype(np.uint32)
    block, reads = dac.Block(dac.pack([1, 2, None, 4, 5], starts, ids)), []
    plain = block.slice
    block.slice = lambda a, b: reads.append((a, b)) or plain(a, b)
    assert token_ids.checksums(block) == [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert reads == [(0, 4000)]
    assert token_ids.checksums(dac.Block(dac.pack([], np.array([0]), np.zeros(0, np.uint32)))) == []


def test_texts_encoded_at_once_are_encoded_alike(monkeypatch):
    """encode_all looks a word up once for many texts; the ids are those of the tokenizer for each text, whatever its white space."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from leadloom.llm import token_ids

    monkeypatch.setattr(token_ids, "AT_ONCE", 40)
    texts = ["", "  ", "a b a", " the the\x0bthe\x0c\tcat\r\n", "x\u00a0y \u2003z", "\x1cw \x85v", "long " * 30, "na\u00efve caf\u00e9 \u4e2d\u6587"]
    encoder, plain = token_ids.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    looked_up = []
    values = encoder.words.values
    encoder.words.values = lambda keys: looked_up.extend(keys) or values(keys)
    column = pa.array([b"unseen", *(t.encode() for t in texts)], pa.binary()).slice(1)  # as Spark's batches may be sliced
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(column)]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert looked_up.count(b"long") == 1


def test_viterbi_looks_up_no_further_than_pieces_go():
    class Counted(dict):
        looked_up = 0

        def get(self, key, default=None):
            Counted.looked_up += 1
            return super().get(key, default)

    pieces, rng = sentencepiece_viterbi.Pieces(PIECES), random.Random(6)
    words = [" " + "".join(rng.choices("aeiounrstlqu", k=30)) for _ in range(200)]
    wanted = [list(pieces.stream(w)) for w in words]
    pieces.scores = Counted(pieces.scores)
    if hasattr(pieces, "prefixes"):
        pieces.prefixes = Counted(pieces.prefixes)
    assert [list(pieces.stream(w)) for w in words] == wanted
    # Every start against all lengths up to the longest piece is 13 to 16 a character.
    assert Counted.looked_up < 7 * sum(map(len, words)), Counted.looked_up / sum(map(len, words))


def test_encoding_leaves_nothing_in_its_workers(spark, tmp_path):
    import shutil

    model = shutil.copy(PIECES, f"{tmp_path}/pieces.model")
    docs = spark.createDataFrame([(k, f"word{k} the cat") for k in range(64)], "doc_id long, text string").repartition(8)
    assert sentencepiece_viterbi.encode(docs, model).where("round_trip").count() == 64

    def kept(batches):
        import gc

        import pyarrow as pa

        from leadloom.llm.sentencepiece_viterbi import Pieces

        for batch in batches:
            alive = {id(x) for x in gc.get_objects() if isinstance(x, Pieces)} - set(map(id, Pieces._of.values()))
            yield pa.RecordBatch.from_arrays([pa.array([len(alive) + (model in Pieces._of)] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}
