"""Ids of words that are cut at marks and encoded once for all their cases."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from lotwise.llm import repair

PATH = P.path("word_bpe_49k.json")
LETTERS = ["a", "Z", "é", "É", "ß", "ÿ", "Ÿ", "×", "÷", "Ø", "µ", "ª", "İ", "ı", "H̱", "É", "x̸", "я", "Я", "Σ", "9", "²", "'", "'S", "'ll", "*", "", "a" * 70, "<|endoftext|>", "<|ENDOFTEXT|>", "퟿"]


def test_ids_of_words_with_marks():
    """Every start, end and mark together, against the library; words by twos, so that they meet in one call."""
    known = repair.WordIds(PATH)
    texts = [a + b + m for a in LETTERS for b in LETTERS for m in ["", ".", ",", "!?", ";:", "...", "*.", ".x", "́.", " .", "\x1c", "\r"]]
    words = pa.array(sorted(set(texts)))
    assert known.cuts
    for some in (words, words.slice(17, 400), words.slice(0, 0)):
        ids, counts = known.coded(some)
        ends = np.cumsum(counts)
        for w, a, b in zip(some.to_pylist(), ends - counts, ends):
            assert ids[a:b].tolist() == known.library.encode(w, add_special_tokens=False).ids, repr(w)


def test_texts_cut_at_line_ends_and_spaces(spark):
    texts = ["Then\nthen", "a.\n\nb,  c", "\n", " \n ", "x\r\ny.", "é.́", "é\ń.", "H\ṉ", "'\ns", "\tA\t.\n", "naïve, NAÏVE; NAÏVE.", "...\n."]
    library = repair.WordIds(PATH).library
    for r in repair.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect():
        assert np.frombuffer(r.ids, np.uint16).tolist() == library.encode(texts[r.id], add_special_tokens=False).ids + [2], repr(texts[r.id])


def test_a_word_is_encoded_once_for_its_cases_and_marks():
    known = repair.WordIds(PATH)
    given = []
    real = known.given
    known.given = lambda library, texts: (given.extend(texts), real(library, texts))[1]
    known.coded(pa.array(["Éclair", "éclair", "éclair.", "ÉCLAIR,", "Then", "then!", "THEN"]))
    known.coded(pa.array(["Then?", "éclair;"]))
    assert sorted(w for t in given for w in t.split() if w not in repair.MARKS) == ["then", "éclair"]
    held = len(known.words)
    known.coded(pa.array(["éCLAIR:"]))
    assert len(known.words) == held
