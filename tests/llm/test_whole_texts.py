"""Decoys that pass over no letter, and texts encoded and decoded in one step."""

import random
import zlib

import numpy as np
import public_tokenizers as public

from fragloom.llm import bpe, secret_scan


def test_every_letter_of_a_text_is_in_a_decoy_of_every_band(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgHIJ") for _ in range(rng.randrange(1, 9))) for _ in range(900))
    letters = "".join(secret_scan.WORD.findall(text))
    turn = zlib.crc32(text.encode()) % len(letters)
    letters = letters[turn:] + letters[:turn]
    for slab in (secret_scan.SLAB, 1024):  # cut into parts or not
        monkeypatch.setattr(secret_scan, "SLAB", slab)
        (bins,) = secret_scan.decoys([text])
        for kind, name in enumerate(secret_scan.ENCODINGS):
            for at, n in enumerate(secret_scan.BANDS):
                mine = sorted(int(c) % (secret_scan.GRID + 1) for c in bins if c // (secret_scan.GRID + 1) == kind * len(secret_scan.BANDS) + at)
                starts = range(0, len(letters) - n + 1, secret_scan.STEP)
                seen = np.zeros(len(letters), dtype=bool)
                want = []
                for s in starts:
                    seen[s:s + n] = True
                    codes = [secret_scan._CODES[kind].get(c if kind == 2 else c.upper(), ord(c) % len(secret_scan.ALPHABETS[name])) for c in letters[s:s + n]]
                    want.append(secret_scan.score(secret_scan.battery(codes, len(secret_scan.ALPHABETS[name]))))
                assert len(letters) - seen.sum() < secret_scan.BANDS[0]
                assert len(mine) == len(want) and all(abs(a - b) <= 1 for a, b in zip(mine, sorted(want)))


def test_a_decoy_takes_one_approximated_tail_and_scores_as_its_symbols_do(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeZY") for _ in range(rng.randrange(1, 9))) for _ in range(many)) for many in (0, 3, 5, 12, 40, 3000)]
    out, taken, tails = secret_scan.decoys(texts), [], secret_scan._log_tails  # tables of whole numbers are made once a process

    def counting(z, *more):
        taken.append(len(z))
        return tails(z, *more)

    monkeypatch.setattr(secret_scan, "_log_tails", counting)
    assert [sorted(b) for b in secret_scan.decoys(texts)] == [sorted(b) for b in out]
    assert 0 < sum(taken) <= 1.1 * sum(map(len, out))
    for text, bins in zip(texts, out):
        letters = "".join(secret_scan.WORD.findall(text))
        turn = zlib.crc32(text.encode()) % max(len(letters), 1)
        letters, want = letters[turn:] + letters[:turn], []
        for kind, name in enumerate(secret_scan.ENCODINGS):
            size = len(secret_scan.ALPHABETS[name])
            codes = np.array([secret_scan._CODES[kind].get(c if kind == 2 else c.upper(), ord(c) % size) for c in letters], dtype=np.uint8)
            for at, n in enumerate(secret_scan.BANDS):
                starts = range(0, len(codes) - n + 1, secret_scan.STEP)
                if starts:
                    want += [secret_scan._bin(kind, at, x) for x in secret_scan.batteries(np.stack([codes[s:s + n] for s in starts]), size)]
        assert sorted(bins) == sorted(want)


def test_counted_decoys_are_all_decoys():
    bins = np.array([5, 5, 4220, 7, 5], dtype=np.int16)
    assert [a.tolist() for a in secret_scan.unpacked_counts(secret_scan.packed_counts(bins))] == [[5, 7, 4220], [3, 1, 1]]
    assert secret_scan.packed_counts(bins[:0]) == b""


def test_decoding_in_the_same_step_gives_what_decode_gives(spark):
    path = public.path("byte_bpe_50k.tiktoken")
    texts = ["", None, "plain text, é and \U0001f600", "word " * 300, "x" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    both = bpe.encode(df, "text", path, public.PATTERN, 50, 20, back=True)
    apart = bpe.decode(bpe.encode(df, "text", path, public.PATTERN, 50, 20), path)
    assert sorted(map(str, both.select(*apart.columns).collect())) == sorted(map(str, apart.collect()))
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}
