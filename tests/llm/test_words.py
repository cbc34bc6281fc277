import re

import numpy as np
import pyarrow as pa

from framewright.llm import words as W

TEXTS = ["Hello  wörld\tÀB", "", None, " \n ", "a", "ñandú-9x | z\x0b\x0cq r", "x" * 3000]


def test_words_are_those_of_the_patterns():
    buf, off = W.texts(pa.array(TEXTS, pa.string()))
    for kind, pattern in ((W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, ends, first = W.spans(buf, off, kind)
        for i, t in enumerate(TEXTS):
            low = (t or "").translate({c: c + 32 for c in range(65, 91)}) if kind is W.ALNUM else (t or "")
            got = [buf[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            if kind is W.ALNUM:
                got = [g.translate({c: c + 32 for c in range(65, 91)}) for g in got]
            assert got == re.findall(pattern, low)


def test_hashes_fold_ascii_case_and_tell_words_apart():
    words = ["The", "the", "THE", "thé", "ab", "ba", "É", "é"] + [f"w{i}" for i in range(2000)]
    buf, off = W.texts(pa.array([" ".join(words)]))
    starts, ends, _ = W.spans(buf, off, W.SPACED)
    h = W.hashes(buf, starts, ends)
    assert h[0] == h[1] == h[2] != h[3] and h[6] != h[7]
    assert len(np.unique(h)) == len(words) - 2


def test_grams_of_short_rows():
    buf, off = W.texts(pa.array(["a b c", "a b", "", "a", "b a"]))
    starts, ends, first = W.spans(buf, off, W.SPACED)
    g, at = W.grams(W.hashes(buf, starts, ends), first, 2)
    assert np.diff(at).tolist() == [2, 1, 0, 1, 1]
    assert g[0] == g[2] and g[2] != g[4] and g[3] not in g[[0, 1, 4]]
