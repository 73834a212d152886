"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import audio, bpe, fingerprint, licenses, neardup, packing, pii, quality, suffixes, warc
from tidemark.llm.common import tokenizer

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1 ----------------------------------------------------------------------------------------
def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def hard_texts():
    r = random.Random(4)
    parts = ["a@b.c", "@", ".", "..", "a.b", "_x@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4", "4111 1111 1111 1111", "4111111111111111", "5", " ", "-", "+1 (212) 555-0100", "+", "(", "é", "😀", "token = \"0123456789abcdef0123456789abcdef\"", "x" * 30]
    return ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(400)] + ["a@" + ".b" * 30000, "1" * 50000, "9-" * 30000, "a" * 100000 + "@", "+1" + " " * 50000, "me@x.org " * 700]


def test_pii_spans(spark, documents):
    texts = hard_texts()
    df = spark.createDataFrame(list(enumerate(texts, 10_000_000)), "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    got = as_dict(pii.digest(df))
    for r in df.collect():
        want = base_spans(r.text)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.text[:100]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert set(want) <= set(row.spans.split(","))
        for s in filter(None, row.spans.split(",")):
            kind, a, b = s.split(":")
            assert kind != "secret" or re.match("(?i)(token|secret|api|pass)", r.text[int(a) : int(b)])


def test_pii_columns(odd):
    """The contract's columns first, in its order."""
    assert pii.digest(odd).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_pii_reliabilities():
    """EM trusts labelers that agree more than one that goes against them, and silence says nothing."""
    right, post = pii.reliabilities({"111--": 40, "1111-": 40, "10--0": 60, "101--": 5})
    assert right[4] > 0.9 and right[1] > 0.6 and post["1111-"] > 0.9 > 0.1 > post["10--0"]
    silent, _ = pii.reliabilities({"1----": 50})
    assert silent[2:] == pytest.approx([pii.PRIOR[n] for n in ("gazetteer", "cue", "against")])


def test_pii_classifier_learns_from_the_span():
    """Spans of one shape are true, of another false, where votes alone are split."""
    counts = {("ssn", "1111-", "1211"): 60, ("ssn", "11---", "1211"): 30, ("ssn", "10--0", "2122"): 60, ("ssn", "11---", "2122"): 10}
    w = pii.fit(counts)["ssn"]
    score = lambda v, f: float(w @ pii._inputs(v, f))
    assert score("1111-", "1211") > 0 > score("10--0", "2122") and score("11---", "1211") > score("11---", "2122")
    assert not pii.fit({})["ssn"].any()


def test_pii_added_spans(spark):
    """Numbers, secrets and names with their cues are found; look-alikes with counter-evidence are not."""
    r, rows, want = random.Random(12), [], {}
    digits = lambda n: "".join(r.choices("123456789", k=n))
    names = ["Anna", "Peter", "Maria", "Thomas"]
    for i in range(400):
        kind = ("ssn", "iban", "secret", "person", "none")[i % 5]
        value = {"ssn": f"{r.randint(100, 600)}-{digits(2)}-{digits(4)}", "iban": f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", "secret": f"api_key = {''.join(r.choices('0123456789abcdef', k=32))}", "person": f"Mr. {r.choice(names)} Berg{'aeiou'[i % 5]}r", "none": f"{r.randint(900, 999)}-00-0000"}[kind]
        lead = {"ssn": "her social security number is ", "iban": "pay to the bank account ", "secret": "use ", "person": "please write to the contact ", "none": "see the part model invoice "}[kind]
        text = f"some words {lead}{value} and so on"
        rows.append((i, text))
        if kind != "none":
            at = text.index(value)
            want[i] = f"{kind}:{at}:{at + len(value)}"
    got = {x.doc_id: x for x in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [want[i] in got[i].spans.split(",") for i in want]
    assert sum(found) / len(found) > 0.95
    assert not any(got[i].n_ssn for i in range(400) if i not in want)
    assert all(x.n_spans == len([y for y in x.spans.split(",") if y]) for x in got.values())


def test_pii_odd_and_redaction(odd, empty):
    assert pii.digest(odd).count() == odd.count() and pii.digest(empty).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and pii.redact(empty).count() == 0
    text = [r.text for r in out.where("doc_id = 4").collect()]
    assert text == ["write to <EMAIL> or call <PHONE> now"] * 2
    assert out.where("doc_id = 2").first().text is None
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_pii_is_native(odd):
    plan = pii.digest(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 2 ----------------------------------------------------------------------------------------
HEADERS, BODIES = licenses.TEMPLATES, licenses.BODIES
FIRST = min(HEADERS)  # the first name of the template file


def test_license_templates_and_inheritance(spark):
    from pyspark.sql import functions as F

    lines = [
        (1, "LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT"),
        (2, "src/a.py", f"import os\n# {HEADERS[FIRST][0]}\n{'more code here ' * 20}", FIRST),
        (3, "src/b.py", "no licence at all in here", "MIT"),
        (4, "lib/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        (5, "lib/deep/er/c.py", "nothing", "GPL-3.0"),
        (6, "lib/deep/er/d.py", "some other words come first, far more than the licence has itself\n!!LICENSED!! under!! CC!! BY-NC!! 4.0!!", "CC-BY-NC-4.0"),
        (7, "library/e.py", "MIT", "MIT"),
        (8, None, "plain", None),
        (9, "x/y", None, "MIT"),
        (9, "x/y", "", "MIT"),
        (10, "whole/words.txt", BODIES["BSD-2-Clause"], "BSD-2-Clause"),
        (11, "whole/under/f.py", "nothing", "BSD-2-Clause"),
    ]
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in lines], "doc_id long, path string, text string")
    got = licenses.scan(df, F.col("path")).collect()
    assert sorted((r.doc_id, r.license or "") for r in got) == sorted((a, d or "") for a, _, _, d in lines)
    by = {r.doc_id: r for r in got}
    assert by[5].inherited_from == "lib" and by[3].inherited_from == "" and by[7].own_license is None
    assert by[10].is_license_file and by[11].inherited_from == "whole"


def test_license_files_are_told_by_their_whole_text():
    """Each whole licence, with a copyright line before it and its lines wrapped anew, is itself."""
    s = licenses.Scorer({"the": 900, "of": 900, "software": 20}, 1000)
    for name, body in BODIES.items():
        words = ("Copyright (c) 2020 Some Person and others. " + body).split()
        text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        assert s.text(text)[1:] == (name, True), name
        assert abs(s.whole(licenses.terms(body))[0] - 1) < 1e-9
    prose = "it was the best of times and it was the worst of times for any person of that age " * 5
    assert s.text(prose) == (0.0, "", False)


@pytest.mark.parametrize("text", ["Released under the MIT License. See LICENSE", "x y z. Released under the\nMIT License.\nother", "Code here is licensed under the MIT License and the documents are not", "Released under the MIT License. Contact the source of the work for version 2"])
def test_license_headers_inside_other_words(text):
    s = licenses.Scorer({"the": 40_000, "of": 40_000, "work": 300}, 50_000)
    assert s.text(text)[1] == "MIT"


def best_part(s, text):
    """The best header's cosine over all parts of a text, up to the longest header."""
    words = text.lower().split()
    known = [i for i, w in enumerate(words) if licenses.VOCABULARY.intersection(licenses.terms(w))]
    parts = ((i, j) for n, i in enumerate(known) for j in known[n:] if j - i < licenses.LONGEST)
    return max((s.line(licenses.terms(" ".join(words[i : j + 1]))) for i, j in parts), default=(0.0, ""))


def test_license_scan_against_all_parts(documents):
    """A text has a licence of its own exactly if some part of it reaches the threshold."""
    from pyspark.sql import functions as F

    some = documents.where("n_chars < 4000")
    df, n = licenses.frequencies(some)
    s = licenses.Scorer(df, n)
    got = as_dict(licenses.scan(some, F.col("source")))
    for r in some.collect():
        score, name = best_part(s, r.text)
        assert (got[r.doc_id].own_license is not None) == (score >= licenses.THRESHOLD), (r.text[:200], score, name)


def test_license_cosine_is_plain_cosine():
    s = licenses.Scorer({"license": 5, "the": 90}, 100)
    words = licenses.terms("Released under the MIT License today")
    score, name = s.line(words)
    w = {t: s.idf.get(t, s.rare) for t in set(words)}
    v = {t: s.idf[t] for t in licenses.terms("Released under the MIT License.")}
    want = sum(w[t] * v[t] for t in v) / np.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in v.values()))
    assert name == "MIT" and abs(score - want) < 1e-9


def test_license_odd(odd, empty, documents):
    from pyspark.sql import functions as F

    path = F.col("source")
    assert licenses.scan(odd, path).count() == odd.count() and licenses.scan(empty, path).count() == 0
    out = as_dict(licenses.scan(documents, path))
    for r in documents.collect():
        if re.search("(?i)licensed under|released under", r.text):
            assert out[r.doc_id].own_license, r.text


# --- 3 ----------------------------------------------------------------------------------------
PIECES = ["a", "b", "ab", "the", "é", "漢字", "'s", "!!'", "'t", "  ", "\n", "1", "23", "😀", " ", "_", "-", "\t", "<|endoftext|>", "\xa0", "ing", "\x1c", "　", "\x0b", "\x85", "\u2028", "\ufeff", "x" * 60]


@pytest.fixture(scope="module")
def small_leaves():
    return bpe.Encoder("byte_bpe_50k.json", leaf=48)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=200))
def test_bpe_equals_library(small_leaves, parts):
    text, tok = "".join(parts), tokenizer("byte_bpe_50k.json")
    ids = tok.encode(text, add_special_tokens=False).ids
    assert small_leaves.ids(text) == ids
    assert small_leaves.decode(ids) == tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", "the", "1", "!", "é", "漢", "😀", "-=", "'s", "_x"])
def test_bpe_long_unsplit(small_leaves, unit):
    for n in (47, 48, 49, 200, 1001):
        text = unit * n
        assert small_leaves.ids(text) == tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_bpe_long_texts_with_odd_space_and_special_tokens(small_leaves):
    """Long unsplit text beside unusual white space and special tokens; batches long enough for threads."""
    r = random.Random(6)
    for unit in ("漢字", "ab-_", "é1"):
        text = "\u3000".join(unit * r.randint(200, 3000) for _ in range(4)) + "<|endoftext|> \xa0" + unit * 2000 + "\x0b"
        assert small_leaves.ids(text) == tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    text = "".join(r.choices("abcdefghij", k=400_000))
    assert bpe.encoder("byte_bpe_50k.json").ids(text) == tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_bpe_digest(documents, odd, empty):
    tok = tokenizer("byte_bpe_50k.json")
    got = as_dict(bpe.digest(documents))
    for r in documents.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    want = [(str(r.doc_id), hashlib.sha256(",".join(map(str, tok.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in bpe.digest(odd).collect()) == sorted(want) and bpe.digest(empty).count() == 0
    assert bpe.encode_documents(odd).where("doc_id = 2").first().ids == []


# --- 4 ----------------------------------------------------------------------------------------
def brute(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aa", b"\xff", b"zz"]), max_size=120), st.sampled_from([16, 40]))
def test_suffix_array(parts, depth):
    data = np.frombuffer(b"".join(parts), np.uint8)
    order = suffixes.suffix_array(data, depth).tolist()
    keys = [data[i : i + depth].tobytes() for i in order]
    assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


def test_windows_are_dealt_once():
    data = np.frombuffer(bytes(random.Random(1).choices(b"abc ", k=3000)), np.uint8)
    _, first, last, _ = suffixes.runs(data)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()


def test_runs_of_plain_texts_are_few():
    """Text of one character, or of a short period, is one run that may repeat inside itself."""
    for text in (b"-" * 100_000, b"ab " * 40_000):
        _, first, last, several = suffixes.runs(np.frombuffer(text, np.uint8))
        assert len(first) <= 3 and several.any() and last[-1] == len(text) - 200


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"gram": 150, "hot": 3}, {"chunk": 1000}, {"plenty": 1000}])
def test_suffix_dedup(documents, options):
    rows = documents.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text.encode() for r in rows], 200), strict=True))
    got = suffixes.digest(documents, **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)


def test_suffix_dedup_odd(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute([(r.text or "").encode() for r in rows], 200), strict=True))
    got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffixes.digest(odd, hot=2).collect())
    assert got == want and suffixes.digest(empty).count() == 0
    out = suffixes.remove(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("text is null").count() == 1
    assert sorted(len(r.text or "") for r in out.collect()) == sorted(len(t or "") - g for (t, g) in ((r.text, w[1][1]) for r, w in zip(sorted(rows, key=lambda r: (str(r.doc_id), len((r.text or "").encode()))), want, strict=True)))
    assert suffixes.remove(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 2}])
def test_suffix_dedup_of_repeated_and_plain_texts(spark, options):
    """Forty equal rows; equal texts under several ids; one character a million times; short periods."""
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    own, passage = prose(300), prose(60)
    rows = [(1, own)] * 40 + [(2, own), (3, passage + " " + prose(80)), (4, prose(70) + " " + passage + prose(20)), (4, prose(90)), (5, prose(50) + passage[:230] + prose(40))]
    rows += [(6, "-" * 3000), (7, "x" + "ab " * 700), (8, "-" * 199), (9, prose(100)), (10, "z" * 900 + "a"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(zip([k for k, _ in rows], brute([(t or "").encode() for _, t in rows], 200), strict=True))
    assert sorted((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in suffixes.digest(df, **options).collect()) == want
    long = spark.createDataFrame([(1, "-" * 1_500_000), (2, own)], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in suffixes.digest(long, **options).collect()} == {1: 1_500_000, 2: 0}


def family(n):
    """Texts that share passages at one place each but differ around them, and copies of whole texts."""
    r = random.Random(11)
    prose = lambda k: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(k))
    core, tails = prose(9), [prose(30) for _ in range(n // 3)]
    texts = [prose(12) + " " + core + " " + (r.choice(tails) if r.random() < 0.7 else prose(30)) for _ in range(n)]
    return list(enumerate(texts + texts[:5]))


@pytest.mark.parametrize("limits", [{}, {"BATCH": 300, "BUCKET": 500}])
def test_suffix_dedup_packs_windows_of_hot_anchors(spark, monkeypatch, limits):
    """An anchor dealt over many tasks: right results, and rows by tasks and buckets instead of one for each window."""
    for k, v in limits.items():
        monkeypatch.setattr(suffixes, k, v)
    made, real = [], suffixes._searched
    monkeypatch.setattr(suffixes, "_searched", lambda *a: made.append(real(*a)) or made[-1])
    rows = family(400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = dict(zip([k for k, _ in rows], brute([t.encode() for _, t in rows], 200), strict=True))
    got = suffixes.digest(df, hot=20).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want and len(got) == len(rows)
    assert sum(w[1] > 0 for w in want.values()) > 100
    windows = sum(max(0, len(t.encode()) - 199) for _, t in rows)
    assert limits or made[0].count() < 4 * len(rows) < windows / 10


def test_suffix_dedup_shuffles_texts_once(documents):
    out = suffixes.digest(documents)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and len(re.findall(r"Exchange hashpartitioning\(k1#\d+L, k2#\d+L, \d+\), ENSURE", plan)) - plan.count("ReusedExchange") <= 3


# --- 5 ----------------------------------------------------------------------------------------
@given(st.lists(st.integers(1, 2048), max_size=120))
def test_difference_fits(sizes):
    windows = packing.divide(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_difference_balances():
    r = random.Random(2)
    sizes = [r.randint(1, 512) for _ in range(400)]
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 50)]
    assert max(loads) - min(loads) < 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "É", "ÀÇ", "İ", "ẞ", "Σ", "|", " | ", "I'LL", "Don't", "ÿ", "<|startoftext|>", "é"]), max_size=80))
def test_words_equal_library(parts):
    text, w = "".join(parts), packing.words("word_bpe_49k.json")
    assert np.frombuffer(w.ids(text), "<u4").tolist() == w.tok.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, tok):
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts}
    seen, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[k])
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(map(len, ids.values())) / (2048 * len(sequences))


def test_pack(documents, odd, empty):
    tok = tokenizer("word_bpe_49k.json")
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert check_packed(packing.pack(documents.coalesce(1)).collect(), texts, tok) > 0.96
    once = odd.dropDuplicates(["doc_id"])
    assert {r.doc_id for r in packing.pack(once).collect()} == {r.doc_id for r in once.collect()}
    assert packing.pack(empty).count() == 0


# --- 6 ----------------------------------------------------------------------------------------
def test_quality_held_out(spark, documents, sf):
    from pathlib import Path

    big = str(Path(sf).parent / "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    w = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, w).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())


def test_quality_reads_no_held_out_label(spark, documents):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(documents, labels) == quality.fit(documents, flipped)).all()


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    w = quality.fit(odd, labels)
    assert quality.score(odd, w).count() == odd.count() and quality.score(empty, w).count() == 0
    none = quality.fit(empty, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5} and quality.keep(odd, none).columns == odd.columns


# --- 7 ----------------------------------------------------------------------------------------
def shingle_set(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints(documents, empty):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    got = as_dict(fingerprint.compare(documents))
    errors = []
    for i, r in enumerate(rows):
        n = rows[(i + 1) % len(rows)].text
        q = len(r.text) // 4
        edited = r.text[: len(r.text) - q] + n[:q]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[r.doc_id].n_chars == len(r.text)
        for other, near in ((edited, got[r.doc_id].near_edited), (n, got[r.doc_id].near_next)):
            a, b = shingle_set(r.text), shingle_set(other)
            errors.append(near - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.04 and abs(np.mean(errors)) < 0.01
    same = {}
    for r in rows:
        assert same.setdefault(r.text, got[r.doc_id].fingerprint) == got[r.doc_id].fingerprint
    assert fingerprint.compare(empty).count() == 0


def test_fingerprints_odd(odd):
    out = fingerprint.compare(odd).collect()
    assert len(out) == odd.count()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = []
    for i, r in enumerate(rows):
        t, n = r.text or "", rows[(i + 1) % len(rows)].text or ""
        q = len(t) // 4
        want.append((str(r.doc_id), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in out) == sorted(want)


# --- 8 ----------------------------------------------------------------------------------------
def brute_similarity(a, b):
    """Probability Jaccard by its definition, and set Jaccard."""
    wa, wb = Counter(a), Counter(b)
    keys = set(wa) | set(wb)
    p = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in keys) for i in keys if wa[i] and wb[i])
    return p, len(set(wa) & set(wb)) / len(keys)


@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.lists(st.integers(0, 12), min_size=1, max_size=40))
def test_similarity(a, b):
    item = lambda x: np.unique(np.array(x, np.uint64), return_counts=True)
    p, j = neardup.similarity(item(a), item(b))
    wp, wj = brute_similarity(a, b)
    assert abs(p - wp) < 1e-9 and abs(j - wj) < 1e-9


def test_registers_estimate_probability_jaccard():
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    a = " ".join(r.choices(words, k=120))
    b = a + " " + " ".join(r.choices(words, k=60))
    x, y = neardup.weighted(a), neardup.weighted(b)
    s = neardup.signatures([x, y], 6000)
    assert abs((s[0] == s[1]).mean() - neardup.similarity(x, y)[0]) < 0.03


def classes_by_brute_force(rows):
    def shingles(text):
        w = text.split()
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]

    texts = [(r.doc_id, shingles(r.text or "")) for r in rows]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(texts):
        sa = set(a)
        for j in range(i):
            b = texts[j][1]
            if not sa.isdisjoint(b) and max(brute_similarity(a, b) if 0.3 < len(a) / len(b) < 3.4 else (0,)) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(texts)}


def test_near_duplicates(documents):
    rows = documents.select("doc_id", "text").collect()
    assert {r.doc_id: r.class_id for r in neardup.classes(documents).collect()} == classes_by_brute_force(rows)


def test_near_duplicate_chain(spark):
    """Neighbours in a chain are near, its ends are not; all are one class."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"n{k}" if k < 8 * i else w for k, w in enumerate(words))) for i in range(12)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 12


def test_near_duplicates_in_a_family_with_a_common_passage(spark):
    """4,000 texts at similarity 0.66 by a passage, and 40 pairs of them at 0.83: exactly those are classes."""
    common = [f"c{k}" for k in range(120)]
    own = lambda i: [f"o{i}x{k}" for k in range(30)]
    rows = [(i, " ".join(common + own(i))) for i in range(4000)]
    rows += [(10_000 + i, " ".join(common + own(i)[:16] + [f"n{i}x{k}" for k in range(14)])) for i in range(1000, 3000, 50)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_near_duplicates_of_any_member(spark):
    """Texts near to one member in the midst of a large class, and to no other, join it."""
    common = [f"c{k}" for k in range(200)]
    own = lambda i: [f"o{i}x{k}" for k in range(16)]
    rows = [(i, " ".join(common + own(i))) for i in range(1000)]
    rows += [(10_000 + i, " ".join([f"n{i}x{k}" for k in range(20)] + common[20:] + own(i))) for i in range(300, 700, 10)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == len(rows)


def test_near_duplicates_with_a_repeated_line(spark):
    """Copies with one line repeated 100 and 400 times: near as sets, far by weights, and by length."""
    base = lambda i: [f"b{i}x{k}" for k in range(100)]
    rows = [(100 * n + i, " ".join(base(i) + base(i)[:8] * n)) for i in range(20) for n in (0, 100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == {k: k % 100 for k, _ in rows}
    item = [neardup.weighted(t) for k, t in rows if k % 100 == 0]
    assert [max(neardup.similarity(item[0], x)) >= 0.8 for x in item[1:]] == [True, True]
    assert neardup.similarity(item[0], item[2])[0] < 0.8


def test_near_duplicates_of_any_length(documents):
    """As brute force, whatever the ratio of lengths, with copies that repeat a line among the texts."""
    some = documents.select("doc_id", "text").where("doc_id % 5 = 0 AND length(text) < 3000")
    more = some.where("doc_id % 10 = 0").selectExpr("doc_id + 1000000 AS doc_id", "concat(text, repeat(concat(' ', substring_index(text, ' ', 9)), 60)) AS text")
    both = some.unionByName(more).checkpoint()

    def items(rows):
        return [(r.doc_id, neardup.weighted(r.text or "")) for r in rows]

    texts = items(both.collect())
    near = [(i, j) for n, (i, a) in enumerate(texts) for j, b in texts[:n] if np.intersect1d(a[0], b[0]).size and max(neardup.similarity(a, b)) >= 0.8]
    label = {i: i for i, _ in texts}
    while any(label[i] != label[j] for i, j in near):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: r.class_id for r in neardup.classes(both).collect()} == label


def linked_by_shared_shingles(rows):
    """Classes by exact similarity of every two texts that share a shingle."""
    holders, label = {}, {r.doc_id: r.doc_id for r in rows}
    items = {r.doc_id: Counter(shingles_of(r.text or "")) for r in rows}
    for k, c in items.items():
        for s in c:
            holders.setdefault(s, []).append(k)

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for k, c in items.items():
        for j in {j for s in c for j in holders[s] if j < k}:
            a, b = find(k), find(j)
            if a != b:
                d = items[j]
                both = c.keys() & d.keys()
                plain = len(both) / (len(c) + len(d) - len(both))
                na, nb = c.total(), d.total()
                if plain >= 0.8 or sum(min(c[s] / na, d[s] / nb) for s in both) >= 0.8 and brute_similarity(list(c.elements()), list(d.elements()))[0] >= 0.8:
                    label[max(a, b)] = min(a, b)
    return {k: find(k) for k in items}


def shingles_of(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]


def test_near_duplicates_recall_on_a_thousand_documents(spark, sf):
    from pathlib import Path

    docs = spark.read.parquet(f"{Path(sf).parent}/sf0.01/documents.parquet")
    want = linked_by_shared_shingles(docs.select("doc_id", "text").collect())
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == want


def test_near_duplicates_that_share_an_id(spark):
    """Rows of one id with unrelated texts are classed by their texts, and none of them is lost."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (7, b), (5, "c d e f g h")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in neardup.classes(df).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (7, 5)} and neardup.classes(df).count() == 6
    assert sorted(r.text for r in neardup.distinct(df).collect()) == sorted([a, b, "c d e f g h"])


def test_near_duplicates_odd(odd, empty):
    out = neardup.classes(odd)
    assert out.count() == odd.count() and neardup.classes(empty).count() == 0
    got = {r.doc_id: r.class_id for r in out.collect()}
    assert got[7] == got[1] == 1 and got[3] == got[2] == 2 and got[None] is None
    kept = neardup.distinct(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "6", "8", "None"]
    assert neardup.distinct(empty).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(200, 260)] + [(r.randint(300, 330), r.randint(300, 330)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.label for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(label == find(k) for k, label in got.items()) and set(got) >= {k for k in parent if find(k) != k}


# --- 9 ----------------------------------------------------------------------------------------
def test_telephony_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[255], mu[127], mu[0], mu[128], mu[254]) == (0, 0, -32124, 32124, 8)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def slow_adpcm(block):
    steps, move = audio.adpcm_steps().tolist(), [-1, -1, -1, -1, 2, 4, 6, 8]
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = steps[index]
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value + (-d if n & 8 else d)))
            index = max(0, min(88, index + move[n & 7]))
            out.append(value)
    return out


@given(st.lists(st.binary(min_size=64, max_size=64), min_size=1, max_size=4))
def test_adpcm(blocks):
    got = audio.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64))
    assert got.tolist() == [slow_adpcm(b) for b in blocks]


@given(st.binary(max_size=300))
def test_wave_round_trip(data):
    for codec in (audio.MULAW, audio.ALAW):
        assert audio.unwave(audio.wave(data, codec)) == (codec, 8000, data)
    p = audio.padded(data)
    assert len(p) % 64 == 0 and p and p.rstrip(b"\0") == data.rstrip(b"\0")


def test_resample_keeps_samples():
    pcm = np.array([0, 10, -10, 500, 500, 7], np.int16)
    out = audio.resample(pcm, np.array([3, 6]))
    assert out[::2].tolist() == pcm.tolist() and out[1::2].tolist() == [5, 0, -10, 500, 253, 7]


@given(st.lists(st.integers(-32768, 32767), min_size=1, max_size=40), st.sampled_from([2, 3]))
@settings(max_examples=60, deadline=None)
def test_pcm_coding_is_lossless(samples, up):
    clip = np.repeat(np.array(samples, "<i2"), up)
    clip[1::2] ^= 21845
    assert audio.uncoded(audio.coded(clip.tobytes(), up), up) == clip.tobytes()
    wide = audio.resample(np.array(samples, np.int16), np.array([len(samples)]), up)
    assert not np.frombuffer(audio.coded(wide.tobytes(), up), "<i2")[len(samples) :].any()


def test_media_digest(spark, documents, odd, empty):
    from tidemark.llm.common import fresh_path

    def through(df):
        return audio.digest(audio.stored_and_read(df, fresh_path(spark, "media")))

    for r, d in zip(through(documents).orderBy("doc_id").collect(), documents.orderBy("doc_id").collect(), strict=True):
        p = audio.padded(d.text.encode())
        m = audio.wave(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(d.text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest())
        assert r.pcm_bytes == 4 * r.payload_bytes
    out = through(odd)
    texts = sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(r.payload_sha256 for r in out.collect()) == sorted(hashlib.sha256(audio.padded(t)).hexdigest() for t in texts) and through(empty).count() == 0
    assert out.where("doc_id in (1, 7)").select("feature", "media_sha256").distinct().count() == 1
    clip = audio.store(odd).where("doc_id = 3").first()
    pcm = audio.mulaw_table()[np.zeros(64, np.uint8)]
    assert clip.pcm == np.repeat(pcm, 2).astype("<i2").tobytes() and clip.n_bytes == 0


def test_feature_by_hand():
    """Each part of the feature from its definition, sample by sample."""
    payload = audio.padded(bytes(random.Random(8).randbytes(150)))
    pcm = [int(audio.mulaw_table()[b]) for b in payload]
    wide = [v for i, a in enumerate(pcm) for v in (a, (a + (pcm[i + 1] if i + 1 < len(pcm) else a)) // 2)]
    clip = np.array(wide, "<i2").tobytes()
    assert audio.resampled([b"\0" * 64, payload])[1] == clip
    blocks = [slow_adpcm(payload[i : i + 64]) for i in range(0, len(payload), 64)]
    want = [sum(v * v for v in pcm) // len(pcm), sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False)), zlib.crc32(clip), zlib.crc32(np.array([int(audio.alaw_table()[b]) for b in payload], "<i2").tobytes()), zlib.crc32(np.array(blocks, "<i2").tobytes())]
    assert audio.features([b"\0" * 64, payload], audio.resampled([b"\0" * 64, payload]))[1] == ":".join(map(str, want))


# --- 10 ---------------------------------------------------------------------------------------
PAGES = [(5, "http://a/\r\nX", "x" * 200), (3, None, "x" * 200), (9, "u", "x" * 200), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "é😀" * 60), (8, "u", "\x1f\x8b\x08 no member here, WARC/1.0 \r\n\r\n" * 20), (3, None, "x" * 200)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    df = spark.createDataFrame([(*p, "q") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    assert warc.write(df, path) == len(PAGES)
    return path


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_warc_any_split(spark, archive, split):
    rows = warc.read(spark, archive, split=split, payload=True).collect()
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    first = {3: None, 5: 3, 9: 3}
    want = sorted((p, "revisit" if first.get(p) else "response", first.get(p), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in PAGES)
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert {r.page_id: r.payload for r in rows if r.record_type == "response"}[7] == ("é😀" * 60).encode()


def test_warc_false_magic(tmp_path):
    """Magic bytes that start no record are passed over, also where a range begins inside a member."""
    from pyarrow import fs

    body = warc.record(1, "u", bytes(random.Random(1).randbytes(5000)), "d", None)
    junk = warc.MAGIC + b"\0" * 7 + b"junk" + warc.MAGIC
    (tmp_path / "x.warc.gz").write_bytes(junk + body + warc.record(2, "u", b"y", "e", None))
    local, name = fs.LocalFileSystem(), str(tmp_path / "x.warc.gz")
    size = (tmp_path / "x.warc.gz").stat().st_size
    for cut in range(0, size, 97):
        ids = [warc.parse(d)["page_id"] for a, b in ((0, cut), (cut, size)) for d in warc.scan(local, name, a, b)]
        assert ids == [1, 2]


def test_warc_query(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    for r in warc.op10_warc_records(spark, sf).collect():
        html = next(p.html for p in pages if p.page_id == r.page_id)
        dup = len(html.encode()) >= 100 and first[html] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if dup else ("response", None))
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op10_warc_records(spark, str(tmp_path)).count() == 0
