"""Row-wise operators against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labtables.llm import (
    fingerprints,
    id_files,
    language_id,
    licenses,
    packing,
    private_data,
    repeats,
)
from labtables.llm._tokens import Encoder, encoder
from labtables.session import scratch_dir

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [row.asDict() for row in df.collect()]


def given(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def reference(path):
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_have_the_ids_of_whole_texts(path, both):
    own, whole = Encoder(path), reference(path)
    texts = [text for _, text in given(both)] + [
        "  a  b\n\n c.. d's 'tis x", "a \n b", "\n", "<|endoftext|> hi", "x. 12,3 ẞ.\t\tq ",
        "don't, can't. I'll! we're?", "a b ́a. ć", "a\x1fb \x85 c", "..a ..b .\n.c",
    ]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == whole(text), text[:80]


SPECIAL = [
    "a <|endoftext|> b", "a  <|endoftext|>\n\nb", "<|startoftext|>x<|endoftext|>", "plain text",
    "<|ENDOFTEXT|> x", "", "don't  <|endoftext|><|endoftext|>", "after all of them",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_special_names_in_texts_have_the_ids_of_the_library(path):
    whole = Tokenizer.from_file(path)
    for text, ids in zip(SPECIAL, encoder(path).encode(SPECIAL), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing_counts_special_names_as_the_library(spark):
    docs = spark.createDataFrame([*enumerate(SPECIAL)], "doc_id long, text string")
    whole = Tokenizer.from_file(BYTES)
    found = {r["doc_id"]: r["length"] for r in rows(packing.packed(docs, BYTES, 0))}
    assert found == {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(SPECIAL)}


def base_spans(text):
    def luhn(digits):
        total = 0
        for k, d in enumerate(reversed(digits)):
            n = int(d) * (2 if k % 2 else 1)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_personal_data(both):
    found = rows(private_data.digest(private_data.find(both)))
    expected = Counter()
    for doc, text in given(both):
        spans = base_spans(text)
        n = Counter(kind for kind, _, _ in spans)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected[doc, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written.encode()).hexdigest()] += 1
    assert expected == Counter(
        (r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found
    )
    order = ["email", "ip", "card", "phone"]
    texts = dict(given(both))
    for r in found:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        keys = [(order.index(k), int(a)) for k, a, _ in spans]
        assert keys == sorted(keys)
        base = {":".join(map(str, s)) for s in base_spans(texts[r["doc_id"]])}
        if r["doc_id"] is not None:
            assert base <= {":".join(s) for s in spans}


def test_added_spans_need_evidence(spark):
    texts = [f"please call my phone ({k}63) 555-{k}869 today" for k in range(2, 9)]
    texts += [f"order id {k}63-555-{k}869x" for k in range(2, 9)] + ["plain words only"] * 5
    texts += [f"phone +1 ({k}10) 555-45{k}0 or mail a{k}@mail.example.com" for k in range(2, 9)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(private_data.digest(private_data.find(docs)))}
    assert all(found[k]["n_added"] == 0 for k in range(7, 19))
    assert sum(found[k]["n_added"] for k in range(7)) == 7


def test_reliabilities_trust_labelers_that_agree():
    counts = {(1, 1, 1): 50, (-1, -1, -1): 50, (1, 1, -1): 8, (-1, -1, 1): 8}
    found = private_data.reliabilities(counts)
    assert found[1, 1, -1] > 0.8 and found[-1, -1, 1] < 0.2


def overlapping(a, b):
    return a[1] < b[2] and b[1] < a[2]


def test_added_spans_against_all_pairs(spark):
    rng = random.Random(4)

    def some(most):
        out = []
        for kind in range(4):
            at = rng.randrange(20)
            for _ in range(rng.randrange(most)):
                stop = at + rng.randrange(1, 12)
                out.append((kind, at, stop))
                at = stop + rng.randrange(25)
        return out

    texts = [(n, some(300 if n < 3 else 6), some(300 if n < 3 else 6)) for n in range(200)]
    array = "array<struct<kind:int,start:long,stop:long>>"
    given = spark.createDataFrame(texts, f"n int, base {array}, likely {array}")
    added = given.select("n", private_data._added(F.col("base"), F.col("likely")).alias("added"))
    found = {r["n"]: [tuple(s) for s in r["added"]] for r in added.collect()}
    for n, base, likely in texts:
        free = [s for s in likely if not any(overlapping(s, b) for b in base)]
        assert found[n] == sorted(s for s in free if not any(overlapping(s, o) and o[:2] < s[:2] for o in free))


def test_redaction_of_a_text_with_many_spans(spark):
    parts = [f"é{k} mail a{k}@example.org or +1 202 555 {k:04d}, " for k in range(1500)]
    docs = spark.createDataFrame([(1, "".join(parts)), (2, "nothing here")], "doc_id long, text string")
    after = {r["doc_id"]: r["text"] for r in private_data.redact(docs).collect()}
    assert after == {
        1: "".join(f"é{k} mail [EMAIL] or [PHONE], " for k in range(1500)),
        2: "nothing here",
    }


def test_redaction_replaces_spans_only(both):
    before = Counter(given(both))
    after = private_data.redact(both)
    assert after.columns == both.columns
    texts = Counter(given(after))
    for (doc, text), n in before.items():
        if not re.search("[0-9@]", text):
            assert texts[doc, text] >= n
    assert "ann.lee@" not in " ".join(text for _, text in texts)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(both, capacity):
    whole = reference(BYTES)
    found = rows(packing.packed(both, BYTES, 0, capacity))
    texts = Counter(given(both))
    by_start = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    expected = Counter()
    total = pieces = 0
    for (doc, text), n in texts.items():
        ids = whole(text) + [0]
        total += len(ids) * n
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            data = b"".join(i.to_bytes(4, "little") for i in ids[a:b])
            expected[doc, a, b - a, zlib.crc32(data)] += n
            pieces += n
    assert by_start == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.05 * total / capacity + 2


def brute_repeats(docs):
    starts = {}
    split = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text)) for doc, text in docs]
    for doc, words in split:
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            starts[key] = min(starts.get(key, float("inf")), float("inf") if doc is None else doc)
    out = Counter()
    for doc, words in split:
        gone = set()
        for k in range(len(words) - 49):
            if starts[tuple(words[k : k + 50])] < (float("inf") if doc is None else doc):
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group_chars", [6 << 20, 20_000])
def test_repeats(both, group_chars, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_CHARS", group_chars)
    found = rows(repeats.remove_repeats(both))
    assert Counter(tuple(r.values()) for r in found) == brute_repeats(given(both))


def test_license_phrases(both):
    found = Counter(
        (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        for r in rows(licenses.scan(both))
    )
    expected = Counter()
    for doc, text in given(both):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        hits = [
            (k, label)
            for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
            for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        places = [k for k, _ in hits]
        labels = ",".join(sorted({label for _, label in hits}))
        expected[doc, len(words), len(hits), min(places, default=None), max(places, default=None), labels] += 1
    assert found == expected


def test_license_templates():
    scanner = licenses.Scanner()

    def labels(text):
        _, places, numbers = scanner.numbers(text)
        return {span[0] for span in scanner.spans(places, numbers)}

    assert labels("x y. Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("the software is free of charge and all is well") == set()
    mit = licenses.TEMPLATES[1][1].replace("without limitation", "with no limit")
    assert labels(mit) == {"mit"}


def test_automaton_matches_like_brute_force():
    scanner = licenses.Scanner()
    text = [*scanner.templates[1][3:17], "zzz", *scanner.templates[6][:9], *scanner.templates[6][2:6]]
    _, places, numbers = scanner.numbers(" ".join(text))

    def inside(run):
        return any(
            t[k : k + len(run)] == run for t in scanner.templates for k in range(len(t))
        )

    found = scanner.matches(places, numbers)
    for first, size, _ in found:
        assert inside(text[first : first + size])
        assert first + size == len(text) or not inside(text[first : first + size + 1])
    assert {first for first, _, _ in found} >= {0, 15}


def test_id_files(both, spark):
    folder = scratch_dir(spark, "test-ids")
    if "://" not in folder:
        folder = f"file://{folder}"
    dictionary, files = id_files.write_ids(both, folder, WORDS, end_id=1)
    found = rows(id_files.read_ids(spark, folder, dictionary, files))
    whole = reference(WORDS)
    expected = Counter()
    for doc, text in given(both):
        ids = whole(text) + [1]
        expected[doc, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    at = 0
    order = sorted(found, key=lambda r: r["start"])
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert ids == sorted(ids)
    with pytest.raises(Exception, match="another dictionary"):
        id_files.read_ids(spark, folder, b"something else", files).collect()


def test_fingerprints(both):
    found = rows(fingerprints.compare_with_next(both))
    docs = [(d, t) for d, t in given(both) if d is not None]
    assert len(found) == both.count()
    ids = Counter(d for d, _ in docs)
    once = {d: t for d, t in docs if ids[d] == 1}
    order = sorted(once, reverse=True)
    by_id = {r["doc_id"]: r for r in found}
    for doc, after in zip(order, order[1:], strict=False):
        if ids.get(8) and (doc > 8 > after):
            continue
        text, k = once[doc], len(once[doc]) // 3
        new = text[: len(text) - k] + once[after][:k]
        assert by_id[doc]["n_chars"] == len(text)
        assert by_id[doc]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        same = next((i for i in range(min(len(text), len(new))) if text[i] != new[i]), min(len(text), len(new)))
        assert by_id[doc]["kept_chars"] == same
        assert 0 <= by_id[doc]["near_next"] <= 1
        if len(text) > 200 and by_id[doc]["near_next"] < 0.3:  # not near copies themselves
            assert by_id[doc]["near_edited"] > by_id[doc]["near_next"]
    prints = {}
    for r in found:
        if r["doc_id"] in once:
            prints.setdefault(once[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_prefix_hashes_answer_any_span():
    a, b = (fingerprints.code_points(t) for t in ("abcabcabd" * 30, "zabcabcabdabc"))
    one, two = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for i in range(0, 20):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert fingerprints.common_extension(one, i, two, j) == n


def test_language(both, odd, empty, sf_dir, spark):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01"))
    model = language_id.fit(language_id.learning_sample(docs))
    found = language_id.predict(docs, model).where(language_id.held_out())
    right = found.where("lang = lang_pred").count()
    assert right >= 0.97 * found.count()
    mixed = rows(language_id.predict(odd.select("doc_id", "text"), model))
    assert len(mixed) == odd.count()
    for r in mixed:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter)
        assert 0 <= r["score"] <= 1
    nothing = language_id.fit(language_id.learning_sample(empty))
    assert nothing is None
    assert {r["lang_pred"] for r in rows(language_id.predict(odd.select("doc_id", "text"), None))} == {"und"}


SCRIPTS = {
    "zh": "的一是不了人我在有他这中大来上个国到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后",
    "yue": "嘅一係唔咗人我喺有佢呢中大嚟上個國到講哋為子同你地出道都時年得就嗰要下以生會自住去之過屋學對可姖入後",
    "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώ",
    "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "he": "אבגדהוזחטיכלמנסעפצקרשת",
    "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसहािीुूेैोौ",
    "ko": "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호",
    "en": "abcdefghijklmnopqrstuvwxyz",
}


def test_language_in_several_scripts():
    rng = np.random.default_rng(3)

    def text(language):
        letters = list(SCRIPTS[language])
        return " ".join("".join(rng.choice(letters, rng.integers(2, 7))) for _ in range(20))

    # Far more letters of English than of the others, so that theirs are not the most frequent.
    sample = [(text(language), language) for language in SCRIPTS for _ in range(12)]
    sample += [(" ".join(text("en") for _ in range(40)), "en") for _ in range(12)]
    order = rng.permutation(len(sample))
    model = language_id.fit([sample[i] for i in order])
    asked = [(text(language), language) for language in SCRIPTS for _ in range(10)]
    found = language_id.score(model, [t for t, _ in asked]).argmax(axis=1)
    right = [model.languages[k] == language for k, (_, language) in zip(found, asked, strict=True)]
    assert np.mean(right) >= 0.97


def test_documents_without_ids_are_spread_over_groups(spark):
    docs = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "CAST(id AS STRING) AS text"
    )
    sizes = [r["count"] for r in repeats._dealt(docs, 100).groupBy("grp").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 180
