import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from quillforge.llm import packing, pieces

ALPHABET = list("   ▁ab\n\t\r\x0b\x1c\x85\xa0 　'séAé日本😀.,0 1​﻿")
ODD = ["", " ", "  ", "a ", " a", "a  b", "a b  ", "<|endoftext|> x", "<s> </s> <unk>", "<0x0A>", "a\x00b", "x" * 5000, "ab " * 3000, " ▁", "▁ ▁", "日本語 テスト　全角", "🤖x"]


def texts(n=3000):
    draw = random.Random(4)
    return ODD + ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(0, 40))) for _ in range(n)]


def split(ids, first):
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_byte_pieces_are_the_librarys():
    found = packing.load(public_tokenizers.path(packing.RANKS)).ids(pa.array(texts()))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    assert split(*found) == [x.ids for x in library.encode_batch(texts(), add_special_tokens=False)]


def test_added_tokens_are_the_librarys():
    draw = random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " word", "'s", "é", "12", "\xa0"]
    rows = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", *("".join(draw.choices(parts, k=draw.randrange(1, 20))) for _ in range(3000))]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert {t.content: k for k, t in library.get_added_tokens_decoder().items()} == packing.ADDED
    assert split(*packing.load(public_tokenizers.path(packing.RANKS), added=True).ids(pa.array(rows))) == want


def test_packed_documents_hold_added_tokens(spark):
    rows = list(enumerate(["a <|endoftext|> b", "no such token", "<|endoftext|>" * 600]))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in rows}
    assert check_packing([tuple(r) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()], 1024, want) == 0


def test_pieces_spans_and_decoding_are_the_librarys():
    model = pieces.load(public_tokenizers.path(pieces.MODEL))
    rows = pa.array(texts())
    ids, first = model.encode(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert model.plain
    assert split(ids, first) == library.encode(texts())
    assert model.decode(ids, first) == library.decode(library.encode(texts()))
    starts, ends = model.spans(rows, ids, first)
    for k, text in enumerate(texts()):
        a, b = first[k], first[k + 1]
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces] if text else []
        assert list(zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)) == want


def _message(number, payload):
    out, n = bytearray([number << 3 | 2]), len(payload)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + payload


def _trie(entries):
    """A double array for a few keys: every node gets a block of 256 units of its own."""
    nodes, values = [{}], [None]
    for key, value in entries.items():
        at = 0
        for b in key:
            if b not in nodes[at]:
                nodes[at][b] = len(nodes)
                nodes.append({})
                values.append(None)
            at = nodes[at][b]
        values[at] = value
    units = np.zeros(256 * (len(nodes) + 1), dtype=np.uint32)
    place = {0: 0}
    for k, row in enumerate(nodes):
        base = 256 * (k + 1)
        here = place[k]
        units[here] |= np.uint32((base ^ here) << 10)
        for b, child in row.items():
            place[child] = base ^ b
            units[place[child]] = b
        if values[k] is not None:
            units[here] |= np.uint32(256)
            units[base] = np.uint32(values[k] | 1 << 31)
    return units.tobytes()


@pytest.mark.parametrize("squeeze", [0, 1])
def test_compiled_character_map_takes_the_longest_prefix(squeeze):
    rules = {"Ａ".encode(): b"A", "fi".encode(): b"F", "fin".encode(): "fün".encode(), "é".encode(): b"e", "　".encode(): b" ", "\t".encode(): b" ", "x".encode(): b""}
    blob, places = b"", {}
    for key, value in rules.items():
        places[key] = len(blob)
        blob += value + b"\0"
    trie = _trie(places)
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        data = f.read()
    spec = _message(2, len(trie).to_bytes(4, "little") + trie + blob) + bytes([3 << 3, 1, 4 << 3, squeeze, 5 << 3, 1])
    model = pieces.Model(data + _message(3, spec))
    assert not model.plain
    for text in ["fine fin fi f", "Ａé x", "  lead and  inner  ", "　tab\t\tend　", "xx", "日x本", "", "a"]:
        proto = model.library.encode(text, return_type="proto")
        rows = pa.array([text])
        ids, first = model.encode(rows)
        assert ids.tolist() == [p.id for p in proto.pieces]
        starts, ends = model.spans(rows, ids, first)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces], text


def test_normalising_a_slice_is_normalising_each_text():
    model = pieces.load(public_tokenizers.path(pieces.MODEL))
    texts = ["", "a", " ", "  two  spaces ", "héllo 日本 x", "\u2581mark \u2581", "\tTab\n", "🙂 🙂", ""]
    out, first, source = model.normalise_all(pa.array(texts))
    for d, text in enumerate(texts):
        normal, came = model.normalise(text.encode())
        assert out[first[d] : first[d + 1]].tobytes() == normal and source[first[d] + d : first[d + 1] + d + 1].tolist() == came


def test_op3_matches_the_library(spark, sf_dir):
    library = pieces.load(public_tokenizers.path(pieces.MODEL)).library
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in pieces.op3_pieces(spark, sf_dir).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert len(rows) == len(docs)
    for d, text in docs:
        found = library.encode(text or "", return_type="proto").pieces if text else []
        ids, spans = [p.id for p in found], np.array([(p.begin, p.end) for p in found], "<u4")
        raw = (text or "").encode()
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))
        assert rows[d].spans_sha256 == sha(spans.tobytes()) and rows[d].spanned_bytes == len(raw)


def test_encode_and_decode_frames(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "héllo  wörld", 3), (3, "héllo  wörld", 3)], "doc_id long, text string, ids int")
    encoded = pieces.encode(docs)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[1].ids == [] and rows[2].ids == [] and rows[3].ends[-1] == len("héllo  wörld".encode())
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {1: "", 2: "", 3: "héllo  wörld"}
    assert pieces.encode(docs.filter("false")).collect() == []


def check_packing(rows, window, want):
    """want: {id: ids}. Gapless windows, each id in one piece, right checksums, little padding."""
    by_window, by_doc = {}, {}
    for r in rows:
        by_window.setdefault(r[5], []).append((r[6], r[2]))
        by_doc.setdefault(r[0], []).append(r)
    padded = 0
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    for key, ids in want.items():
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[key], key=lambda r: r[1]):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    return padded


def test_sum_of_squares_packing():
    draw = random.Random(2)
    packer, rows, want = packing.Packer(64), [], {}
    for d in range(800):
        ids = [draw.randrange(50000) for _ in range(draw.choice([1, 3, 17, 40, 63, 64, 65, 200]))]
        want[d] = ids
        rows += packer.add(d, np.array(ids, "<u4"))
    rows += packer.close()
    assert check_packing(rows, 64, want) == 0


def test_level_is_the_one_with_least_squares():
    draw = random.Random(1)
    for _ in range(200):
        packer = packing.Packer(16)
        packer.count[1:16] = [draw.randrange(4) for _ in range(15)]
        size = draw.randrange(1, 16)

        def squares(level):
            count = packer.count.copy()
            if level:
                count[level] -= 1
            if level + size < 16:
                count[level + size] += 1
            return int((count[1:16] ** 2).sum())

        options = [h for h in range(17 - size) if h == 0 or packer.count[h]]
        assert packer.level(size) == min(options, key=lambda h: (squares(h), h))


def test_pack_frame(spark):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (4, "short text"), (5, "short text")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int").repartition(2)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    assert check_packing([tuple(r) for r in packing.pack(frame).collect()], 1024, want) == 0
    assert packing.pack(frame.filter("false")).collect() == []


def test_op6_matches_the_library(spark, sf_dir):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    rows = packing.op6_packing(spark, sf_dir)
    assert check_packing([tuple(r) for r in rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], 1024, want) == 0


@pytest.mark.parametrize("most", [packing.OPEN, 1 << 17])
def test_most_tails_stay_where_the_rule_placed_them(sf_dir, most):
    """A cut's head goes where there is room, all other pieces of tails by the rule; one partition, as a task sees it."""
    coder = packing.load(public_tokenizers.path(packing.RANKS), added=True)
    texts = pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet", columns=["text"]).column("text").combine_chunks().fill_null("")
    ids, first = coder.ids(texts)
    packer, rows, want = packing.Packer(most=most), [], {}
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        want[d] = [*ids[a:b].tolist(), 0]
        rows += packer.add(d, np.array(want[d], "<u4"))
    rows += packer.close()
    assert check_packing(rows, 1024, want) == 0
    tails = [d for d, x in want.items() if len(x) % 1024]
    pieces_of_tails = sum(r[1] >= r[4] - r[4] % 1024 for r in rows)
    assert packer.placed == len(tails) and pieces_of_tails == len(tails) + packer.cut
    whole = {r[0] for r in rows if r[2] == r[4] % 1024 and r[1] + r[2] == r[4]}
    assert len(whole & set(tails)) > 0.85 * len(tails)


def test_open_windows_are_bounded_and_equal_rows_stay_apart():
    draw = random.Random(7)
    packer, rows, want, most = packing.Packer(64, most=500), [], {}, 0
    for d in range(600):
        ids = [draw.randrange(50000) for _ in range(draw.choice([33, 34, 35, 40]))]  # no two fit into a window
        want[d] = ids
        rows += packer.add(d, np.array(ids, "<u4"))
        most = max(most, packer.held)
        assert packer.held == sum(len(p[2]) for level in packer.open for _, parts in level for p in parts)
    rows += packer.close()
    assert most <= 500 and check_packing(rows, 64, want) == 0
    same = packing.Packer(64)
    twins = [*same.add(1, np.arange(9, dtype="<u4")), *same.add(1, np.arange(9, dtype="<u4")), *same.close()]
    assert len(twins) >= 2 and sum(r[2] for r in twins) == 18
