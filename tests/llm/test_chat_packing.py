import hashlib
import json
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from riskloom.llm import chat, packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["", "a\\", "###", "####", "\\### Assistant: </turn> ok", " </turn>\n### user: x", "</turn></turn>", ":", "\\\\", "\n\n", "é😀", "\\:\\#", "x" * 200_000]


def test_round_trip_of_marks():
    turns = [(r, t) for r in ("user", "assistant", "", "we:ird\\", "a: b") for t in NASTY]
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts_become_the_same_turns(spark):
    said = [("user", "Q"), ("assistant", "A")]
    rows = [
        ("messages", json.dumps({"messages": [{"role": r, "content": t} for r, t in said]}), said),
        ("conversations", json.dumps({"conversations": [{"from": "human", "value": "Q"}, {"value": "A", "from": "gpt"}]}), said),
        ("prompt", json.dumps({"response": "A", "prompt": "Q"}), said),
        ("instruction", json.dumps({"system": None, "instruction": "Q", "output": "A"}), [("system", ""), *said]),
        ("messages", '{"messages": []}', []), (None, '{"messages": [{"role": "user", "text": "x"}]}', []), (None, "[1]", []), (None, "no json", []),
        (None, None, []), (None, '{"prompt": "x"}', []), (None, '{"prompt": "x", "response": 5}', []), (None, '{"messages": [3]}', []),
        ("prompt", '{"prompt": null, "response": "A"}', [("user", ""), ("assistant", "A")])]
    df = spark.createDataFrame([(i, r, "old") for i, (_, r, _) in enumerate(rows)], "id long, record string, layout string")
    for r in chat.format_chats(df).collect():
        assert (r["layout"], chat.read_back(r["formatted"] or "")) == (rows[r["id"]][0], rows[r["id"]][2])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_digests_of_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 1, "assistant", "y"), (2, 0, "user", "x"), (3, 0, None, "t"), (None, 0, "user", "n"),
            (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "v")] + [(5, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(NASTY)] + [(6, 0, "human", "h")] * 7
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.records_of(df))).collect()}
    assert set(got) == {c for c, *_ in rows}
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        learned = "".join(b for _, a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_hold_every_id_once(spark, documents, prose, length):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    docs = [(1, None), (2, ""), (3, "Hello wörld\n\n  it's 42 <|endoftext|> 😀"), (4, " ".join(prose(1, 5000))), (5, "x"), (5, "x"), (None, "null id"), (7, "\n \t  "), (8, "don't" * 3)]
    docs += [(100 + k, " ".join(prose(k, 1 + 7 * k))) for k in range(40)]
    pieces = packing.pack(documents(docs), VOCABULARY, length=length, with_ids=True)
    rows = [r.asDict() for r in pieces.collect()]
    want = sorted((repr(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in docs)
    ids = {}
    for r in rows:
        got = struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])
        assert len(got) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"] and 0 <= r["offset"] <= length - r["length"]
        r["read"] = got
    # Pieces in order of place follow each other without gaps; documents start and end in them.
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    at, found, held = 0, [], []
    for r in rows:
        assert r["sequence_id"] * length + r["offset"] == at and r["start"] == len(held)
        at += r["length"]
        held += r["read"]
        if len(held) == r["doc_tokens"]:
            found.append((repr(r["doc_id"]), tuple(held)))
            held = []
    assert not held and sorted(found) == want
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, length=length).collect()}
    assert all(r["n_tokens"] == length for k, r in whole.items() if k < max(whole)) and sum(r["n_tokens"] for r in whole.values()) == at
    last = whole[max(whole)]
    assert len(last["ids"]) == 4 * (last["n_tokens"] if last["n_tokens"] & (last["n_tokens"] - 1) == 0 else length)
    assert packing.pack(documents([]), VOCABULARY).count() == 0


SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|> b  <|endoftext|>\n", "<|endoftext|", "x  <|endoftext|>  y"]


def test_added_tokens_are_one_id(spark, documents):
    """The queries' ids are those of the file under its default settings."""
    t = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(documents(list(enumerate([*SPECIAL, *NASTY]))), VOCABULARY, length=1 << 20, with_ids=True, encode_special_tokens=False)
    got = {r["doc_id"]: list(struct.unpack(f"<{r['length']}I", r["ids"])) for r in pieces.collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in enumerate([*SPECIAL, *NASTY])}
    assert got[0] == [64, 50256, 65, 1]


def test_queries_encode_added_tokens(spark, tmp_path, documents):
    import corpus_pipeline
    from riskloom.llm import queries

    docs = documents([(0, SPECIAL[0])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for pieces in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert [r["doc_tokens"] for r in pieces.collect()] == [4]


def test_roles_with_line_breaks_keep_their_turns(spark):
    """A role that reads like two, and a table without conversations."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user\nassistant", "hello"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "system\nuser", "x"), (3, 1, "assistant", "y")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_chats(chat.records_of(spark.createDataFrame(rows, schema)))).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert chat.digests(chat.format_chats(chat.records_of(spark.createDataFrame([], schema)))).count() == 0


def test_slices_are_bounded_and_whole():
    texts = ["", None, "a" * 700_000, "b" * 700_000, None, "c" * 5_000_000, "", *["d" * 1000] * 3000]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "n": list(range(len(texts)))})
    slices = list(packing._slices(batch, "text"))
    assert [x for s in slices for x in s["n"].to_pylist()] == list(range(len(texts))) and all(s.num_rows for s in slices)
    assert max(sum(len(x or "") for x in s["text"].to_pylist()[1:]) for s in slices) <= packing.SLICE
    assert not list(packing._slices(batch.slice(0, 0), "text"))
