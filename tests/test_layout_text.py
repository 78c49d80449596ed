"""The layout URL machine, the clean-up around it and the recursive splitter, each against a plain loop."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.functions import urls as U
from scholarlake.plans.views import view

ENDS = tuple(f" {w} " for w in ("and", "the", "on", "at", "in", "from", "or", "to", "are", "is"))


def machine(text):
    for c in "\u200b\u200c\u200d\u00ad\ufeff":
        text = text.replace(c, "")
    text = re.sub(r"(?i)https?://\s*urlde\s*fense\s*\.\s*com\s*/\s*v3\s*/\s*__\s*/?", "", text)
    text = re.sub(r"(?i)(https?)\s*:\s*/\s*/\s*", r"\1://", text)
    out, i = [], 0
    while i < len(text):
        scheme = re.compile("(?i)https?://").match(text, i)
        if not scheme:
            out.append(text[i])
            i += 1
            continue
        out.append(scheme[0])
        i, n = scheme.end(), 0
        while i < len(text) and n < 200 and not text.startswith(ENDS, i):
            if text[i] in " \t\n\r":
                i += 1
            elif text[i].isalnum() or text[i] in ".-_/=?&:#%":
                out.append(text[i])
                i, n = i + 1, n + 1
            else:
                break
    return "".join(out)


def cleaned(text):
    text = text.replace("\u2013", "-").replace("\u2014", "-")
    text = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", text)
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r" ([.,])", r"\1", text)
    text = machine(text)
    urls = re.findall(r"(?i:https?://)\S+", text)
    held = re.sub(r"(?i:https?://)\S+", "__URL__", text)
    held = re.sub(r"(?:\b[a-zA-Z]\b\s+){4,}[a-zA-Z]\b", lambda m: "".join(m[0].split()), held)
    text = "".join(a + b for a, b in zip(held.split("__URL__"), [*urls, ""], strict=True))
    text = re.sub(r"(https?://[^\s]{10,}?)(https?://)", r"\1 \2", text)
    low = text.lower()
    if low.startswith(("orcid", "keywords", "received", "accepted", "submitted", "correspondence", "references")) or "\u00a9" in text or "copyright" in low:
        return None
    return text.strip()


def split(text, size, overlap, at=("\n\n", "\n", " ")):
    """Chunks by recursion over pieces, merged one after another."""
    out, run = [], []

    def merge():
        held, total = [], 0
        for p in run:
            if total + len(p) > size:
                if held:
                    out.append("".join(held).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held).strip())
        run.clear()

    cut = next((s for s in at if s in text), "")
    parts = text.split(cut) if cut else list(text)
    for p in [p if not i or not cut else cut + p for i, p in enumerate(parts)]:
        if not p:
            continue
        if len(p) < size or not cut:
            run.append(p)
            continue
        merge()
        out += split(p, size, overlap, at[at.index(cut) + 1 :])
    merge()
    return [c for c in out if c]


def texts(seed, n=250):
    r = random.Random(seed)
    bits = ["https://", "http://", "HTTP : / / ", "https:/ /", "zen odo", ".org", "/rec", "?a=", "&b", "é1", " and ", " the", " to ", " is", "\n", "\t", "  ", " ", " ", "(x)", ".", ",", "-", "\u2014", "\u200b", "a b c d e f ", "x", "urlde fense.com/v3/__", "copy", "Received ", "٣", "½", "ß", "a-\n b"]
    out = ["".join(r.choice(bits) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    out += [f"see https://{'a' * k}{gap}{'b' * 5} c, and (d)" for k in (198, 199, 200, 201) for gap in ("", " ", "  \n", " and ")]
    return [*out, "", "https://", "https:// ", "https://" + " " * 30_000 + "x", "https://" + "/a" * 20_000, "https://x" + " and" * 9_000, "a b" + " " * 20_000]


def mapped(spark, values, *exprs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in frame.select("i", *exprs).orderBy("i").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_layout_urls_and_cleaning(spark, seed):
    values = [*texts(seed), None]
    got = mapped(spark, values, U.layout_urls("t"), U.clean_paragraph("t"))
    for v, (url, clean) in zip(values, got, strict=True):
        assert url == (None if v is None else machine(v)), v[:200]
        assert clean == (None if v is None else cleaned(v)), v[:200]


def passages(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(0, 120)):
            text += r.choice(["word", "a", "longer", "é", "x" * r.choice([3, 40, 200]), "𝒳𝒴", ""])
            text += r.choice([" ", " ", " ", " ", "\n", "\n\n", "\n\n\n\n", "\t", "", "\r\n", "\x1f "])
        out.append(text)
    return [*out, "", " ", "\n\n", "x" * 5000, "\n\n" + "ab " * 3000, None]


@pytest.mark.parametrize(("size", "overlap"), [(60, 15), (25, 24), (200, 0), (1800, 250)])
def test_recursive_chunks(spark, size, overlap):
    values = passages(size)
    got = mapped(spark, values, T.recursive_chunks("t", size, overlap))
    for v, (chunks,) in zip(values, got, strict=True):
        assert (chunks or []) == ([] if v is None else split(v, size, overlap)), v[:200]


def test_chunks_of_whole_documents(spark):
    from scholarlake.operators import retrieval

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = retrieval.chunk_documents(docs, recursive=True).orderBy("doc_id", "chunk").collect()
    held = {}
    for row in rows:
        held.setdefault(row.doc_id, []).append(row.text)
    want = {d.doc_id: split(d.text, 1800, 250) for d in docs.where(F.col("text") != "").collect()}
    assert held == {k: v for k, v in want.items() if v} and sum(map(len, held.values())) > len(held)


def sentences(text):
    out, now = [], ""
    parts = re.split(r"([.!?;])\s+", text)
    for i, part in enumerate(parts):
        if not part:
            continue
        if part in ".!?;":
            now = now.rstrip() + part
            after = parts[i + 1].strip() if i + 1 < len(parts) else ""
            if not after or after[0].isupper() or after[0].isdigit():
                out.append(now.strip())
                now = ""
            else:
                now += " "
        else:
            now += part.strip() + " "
    return [*out, now.strip()] if now.strip() else out


def compacted(text):
    return re.sub(r"(?:\b[a-zA-Z]\b\s+){4,}[a-zA-Z]\b", lambda m: "".join(m[0].split()), text)


def normalized(text):
    text = re.sub(r"(\w)-\n(\w)", r"\1\2", text)
    text = re.sub(r"(?i)(https?)\s*:\s*//\s*", r"\1://", text)
    text = re.sub(r"[ \t]{2,}", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines, now = [], ""
    for line in map(str.strip, text.split("\n")):
        if not line:
            lines += [now] if now else []
            lines += [""] if lines and lines[-1] else []
            now = ""
        elif now and now[-1] in ".!?;":
            lines.append(now)
            now = line
        else:
            now = f"{now} {line}" if now else line
    text = "\n".join([*lines, now] if now else lines)
    urls = re.findall(r"(?i:https?://)\S+", text)
    held = compacted(re.sub(r"(?i:https?://)\S+", "__URL__", text))
    text = "".join(a + b for a, b in zip(held.split("__URL__"), [*urls, ""], strict=True))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(sentences(text)))


def rough(seed, n=400):
    r = random.Random(seed)
    bits = ["One", "two", "three", "É", "5", ".", "!", "?", ";", ". ", "! ", "?; ", "; ", ".!? ", "...", "\n", "\n", "\n\n", " \n\t\n ", "\r\n", "\r", " ", "  ", "\t", "\u00a0", "\x1f", "\x85", "a b c d e ", "x-\ny", "http : // x.org/a. B", "https://y.z/a b", "²", "ǅ", "Ⓐ", "\x01", "(", "e.g. "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(n)] + ["", " ", ".", ". . .", "\n\n", "a. " * 3000, " " * 20_000 + "a" + "\n" * 5000 + "b", None]


@pytest.mark.parametrize("seed", [3, 4])
def test_sentences_and_normalize(spark, seed):
    values = rough(seed)
    got = mapped(spark, values, T.sentences("t"), T.normalize("t"), T.compact_letters("t"))
    for v, (cut, whole, compact) in zip(values, got, strict=True):
        assert cut == (None if v is None else sentences(v)), repr(v)[:200]
        assert compact == (None if v is None else compacted(v)), repr(v)[:200]
        if v is None or "\x01" not in v:  # the mark of paragraph breaks
            assert whole == (None if v is None else normalized(v)), repr(v)[:200]


def test_queries_on_whole_tables(spark):
    from scholarlake.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in QUERIES["text_normalize"](spark, sf).collect()} == {i: normalized(t) for i, t in docs.items()}
    held = {}
    for r in QUERIES["sentence_split"](spark, sf).orderBy("doc_id", "pos").collect():
        held.setdefault(r.doc_id, []).append(r.sentence)
    assert held == {i: s for i, t in docs.items() if (s := sentences(t))}
    blocks = {(r.doc_id, r.seq): r.text for r in view(spark, sf, "papers_view").collect()}
    spaced = {k: compacted(re.sub(r"([A-Za-z])(?=[A-Za-z])", r"\1 ", t)) for k, t in blocks.items()}
    assert {(r.doc_id, r.seq): r.text for r in QUERIES["spaced_letter_compaction"](spark, sf).collect()} == spaced
    parts = {(k, i): c for k, t in blocks.items() for i, p in enumerate([p.strip() for p in re.sub(r"\n{3,}", "\n\n", t.replace("\r\n", "\n").replace("\r", "\n")).split("\n\n") if p.strip()]) if (c := cleaned(p))}
    assert {((r.doc_id, r.seq), r.pos): r.text for r in QUERIES["layout_clean_paragraphs"](spark, sf).collect()} == parts


def took(spark, text, *exprs):
    """Seconds of each expression over copies of a text in one task, the least of three runs."""
    frame = spark.range(0, 24, 1, 1).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).persist()
    frame.count()

    def once(e):
        began = time.perf_counter()
        frame.select(F.sum(F.length(e))).collect()
        return time.perf_counter() - began

    out = [min(once(e) for _ in range(3)) for e in exprs]
    frame.unpersist()
    return out


def test_prose_is_cut_without_an_array_of_its_parts(spark):
    prose = "The stations were read twice a day, and again at night. All of them are open; none was moved.\n" * 800
    cut, plain = took(spark, prose, F.array_join(T.sentences("t"), "\n"), F.regexp_replace("t", rf"([.!?;]){T.SPACE}+", "$1\n"))
    assert cut < 10 * plain, (cut, plain)
    assert mapped(spark, [prose, " A b . c ?  D. ", "a. É ! b; ²x .", "?\n"], T.sentences("t")) == [(sentences(v),) for v in (prose, " A b . c ?  D. ", "a. É ! b; ²x .", "?\n")]


def test_letters_of_a_run_are_looked_at_once(spark):
    spaced = ("a" + " " * 60) * 1500 + "b"
    compact, plain = took(spark, spaced, T.compact_letters("t"), F.regexp_replace("t", rf"([a-zA-Z]){T.SPACE}+(?=[a-zA-Z])", "$1"))
    assert compact < 3 * plain, (compact, plain)
    assert mapped(spark, [spaced], T.compact_letters("t")) == [("a" * 1500 + "b",)]


def test_only_what_follows_a_scheme_is_glued(spark):
    prose = "The stations were read twice a day, and again at night; none was moved.\n" * 2000
    text = prose + "See https://zen odo.org/ab c/d1 which lies in the archive, and http://x.org/q= 7 end"
    glued, plain = took(spark, text, U.canonical("t"), F.regexp_replace("t", "(?i)https?://|__", "#"))
    assert glued < 8 * plain, (glued, plain)
    assert mapped(spark, [text, "no link", "a__b", None], U.canonical("t")) == [(prose + "See https://zenodo.org/abc/d1 which lies in the archive, and http://x.org/q=7 end",), ("no link",), ("a__b",), (None,)]
