"""Long texts are encoded over several slices, and what is kept between them is bounded."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from ledgerlens.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("size", [1, 7, 60])
def test_slices_make_no_difference(monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE", size)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 4000)
    m, library, r = pieces.PieceModel(pieces.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(size)
    texts = [None, "", " ", "\n", "a  b", "x" * 300] + ["".join(r.choice("aab cde  \n▁éß😀th") for _ in range(r.randint(0, 300))) for _ in range(150)]
    row, got, kept = pieces._Row(m, True), [], 0
    for part in pieces._slices(m, pa.array(texts)):
        table = m.known([c for _, cuts, _ in part for c in cuts], True)
        kept = max(kept, m._bytes)
        for k, cuts, ends in part:
            row.add([table[c] for c in cuts])
            if ends:
                got.append((k, row.end()))
                row = pieces._Row(m, True)
    assert [k for k, _ in got] == list(range(len(texts)))
    for t, (_, (n, raw, ids_sha, text_sha)) in zip(texts, got):
        ids = library.encode(t or "", add_eos=True)
        assert n == len(ids) and raw == b"".join(i.to_bytes(4, "little") for i in ids)
        assert ids_sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and text_sha == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert kept < 4000 + 300 * (300 + 12 * 48) and len(m._passing) == sum(len(c) > pieces.LOCKSTEP for c in m._young)
