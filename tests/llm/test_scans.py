"""Secret scan, license scan and language id against plain versions and on the defined cases."""

import hashlib
import random
import re
import textwrap
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.llm import langid, licenses, secrets
from tremor.llm.common import table


def base_spans(text):
    """The base scan as it is defined: every maximal match, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.I) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PIECES = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "x", "é", "\n", "a" * 8, "${A}", "A", "+"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_are_all_there(text):
    spans, _ = secrets.scan_text(text)
    assert [s for s in spans if s[1] < 3] == base_spans(text)
    assert spans == sorted(spans)


def test_literals_follow_names_and_constants():
    text = 'A = "abcd1234efgh"\ndb.password = A + "zz99"\n"client_secret": "Q9x7LmP0sTq2"\ncolour = "abcd1234efgh9999"\npassword = "changeme"\n'
    literals = {text[lo:hi] for lo, k, hi in secrets.scan_text(text)[0] if k == 3}
    assert literals == {"abcd1234efgh", "zz99", "Q9x7LmP0sTq2"}
    assert secrets.scan_text("secret = key\nkey = secret\n")[0] == []  # names that only name each other end


def literals(text):
    return {text[lo:hi] for lo, k, hi in secrets.scan_text(text)[0] if secrets.KINDS[k] == "literal"}


def test_secrets_follow_chains_of_any_length():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    parts = [word(7) for _ in range(300)]
    assert literals("secret_key = " + " + ".join(f'"{x}"' for x in parts)) == set(parts)
    assert literals("secret_key = (\n" .replace("(", "") + "") == set()
    broken = 'client_secret = "' + parts[0] + '" +\n    "' + parts[1] + '"\n    + "' + parts[2] + '" \\\n    "' + parts[3] + '"\nother = 1'
    assert literals(broken) == set(parts[:4])
    long = word(6000)
    assert literals(f'a = "{long}"\nmy_password = a') == {long}
    name = lambda i: "v_" + "".join("abcdefghij"[int(c)] for c in str(i))
    chain = [f"{name(i)} = {name(i + 1)}" for i in range(5000)] + [f'{name(5000)} = "{parts[0]}"', f"password = {name(0)}"]
    for order in (chain, chain[::-1], rng.sample(chain, len(chain))):
        assert literals("\n".join(order)) == {parts[0]}
    assert literals("password = b\nb = a\na = password\nc = c") == set()  # a circle
    doubled = [f'{name(0)} = "{parts[5]}"'] + [f"{name(i + 1)} = {name(i)} + {name(i)}" for i in range(2000)] + [f"password = {name(2000)}"]
    assert literals("\n".join(doubled)) == {parts[5]}
    summed = [f'{name(0)} = "ab"'] + [f'{name(i + 1)} = {name(i)} + "{word(9)}"' for i in range(3000)] + [f"my_secret = {name(3000)}"]
    assert len(literals("\n".join(summed))) == 3001


def test_value_of_concatenations():
    rng = random.Random(5)
    for _ in range(200):
        parts = ["".join(rng.choice("abcX*.") for _ in range(rng.choice([0, 1, 5, 40, 90]))) for _ in range(rng.randrange(1, 5))]
        whole, got = "".join(parts), secrets.concatenated([secrets.value_of(x) for x in parts])
        assert (got.n, got.head, got.tail) == (len(whole), whole[:32], whole[-32:]) and dict(got.counts) == {c: whole.count(c) for c in set(whole)}
        bits = -sum(whole.count(c) / len(whole) * np.log2(whole.count(c) / len(whole)) for c in set(whole)) if whole else 0
        expected = 0.0 if len(whole) < 6 or secrets.PLACEHOLDER.match(whole) else min(1.0, len(whole) * bits / 64)
        assert abs(secrets.value_weight(got) - expected) < 1e-9


def test_secret_report(spark, docs):
    rows = [(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (2, None), (3, ""), (4, "plain"), (4, "plain"), (None, "x"), (7, "z" * 200_000 + " password=abcdefgh1")]
    got = {(r.doc_id, r.n_assign): r for r in secrets.secret_digest(docs(rows, extra=True)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2, 0].base_sha256 == got[3, 0].base_sha256 == empty and got[2, 0].spans == ""
    one = got[1, 1]
    assert (one.n_hex, one.n_access) == (1, 0)
    text = rows[0][1]
    assert one.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{lo}:{hi}" for lo, k, hi in base_spans(text)).encode()).hexdigest()
    assert got[7, 1].spans.startswith("assign:200001:")
    assert secrets.secret_digest(docs([])).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "CC", "-", " ", "general", "Public", "license", "all rights reserved", "\n", "é", "x", "'s", "0"]), max_size=16).map("".join))
def test_license_base(text):
    index = licenses.TemplateIndex(licenses.TEMPLATES, {}, 0.85)
    n, base, blocks = licenses.scan_text(text, index)
    words = plain_words(text)
    expected = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert (n, base) == (len(words), expected)
    at = 0
    found = []
    for line in text.split("\n"):  # brute force: every line against every template
        have = set(plain_words(line))
        for label, t in licenses.TEMPLATES:
            need = set(plain_words(t))
            if have and len(have & need) >= 0.85 * len(need) - 1e-9:
                found.append((at, label))
        at += len(plain_words(line))
    assert sorted((w, b) for w, _, b, _ in blocks) == sorted(found)


def test_long_texts_of_notices_take_no_long_time():
    index = licenses.TemplateIndex(licenses.TEMPLATES, {}, 0.85)
    for unit in ("cc by ", "all rights reserved ", "Licensed under the MIT License ", "the of and this ", "permission notice shall be included in "):
        text = unit * (1_000_000 // len(unit))
        began = time.process_time()
        n, base, _ = licenses.scan_text(text, index)
        assert time.process_time() - began < 4, unit
        assert n == len(text.split())
        if unit == "cc by ":
            assert base == [(k, "cc-by") for k in range(0, n, 2)]


def test_license_report(docs):
    rows = [(1, "Intro.\nLicensed under CC BY-NC 4.0.\nAll rights reserved"), (2, None), (3, ""), (4, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licenses.license_digest(docs(rows, extra=True)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (11, 2, 3, 8, "cc-by,reserved", 1.0)
    assert "cc-by-nc" in got[1].labels.split(",")
    assert (got[2].n_words, got[2].labels, got[2].first_word, got[2].score) == (0, "", None, 0.0)
    assert (got[4].labels, got[4].n_base, got[4].score) == ("mit", 0, 1.0)
    assert licenses.license_digest(docs([])).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_license_notices_wrapped_over_lines(mark):
    index = licenses.TemplateIndex(licenses.TEMPLATES, {}, 0.85)
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        lines = [mark + x for x in textwrap.wrap(t, 30)]
        n, _, blocks = licenses.scan_text("\n".join(["zzz " * 40, *lines, "yyy " * 40, *lines]), index)
        size = len(plain_words(t))
        for start in (40, 80 + size):  # a repeated first word may stay outside
            assert any((b, c) == (label, 1.0) and start <= w and w + m <= start + size for w, m, b, c in blocks), k
        assert n == 80 + 2 * size
        scattered = (" zzz" * 60).join(plain_words(t))
        assert licenses.scan_text(scattered, index)[2] == []


def test_license_blocks_match_brute_force():
    rng = random.Random(6)
    templates = [("a", "one two three four five six seven"), ("b", "one one two eight nine ten"), ("c", "three nine")]
    index = licenses.TemplateIndex(templates, {b"three": 2}, 0.85)
    vocabulary = "one two three four five six seven eight nine ten".split()
    hits = 0
    for _ in range(600):
        words = [rng.choice(vocabulary) if rng.random() < 0.6 else "x" for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            words[5:5] = templates[0][1].split()
        got = licenses.scan_text("\n".join(words), index)[2]
        for label, t in templates:
            need, width = set(t.split()), licenses.WINDOW * len(t.split())
            share = lambda i, n: len(need & set(words[i : i + n])) / len(need)  # noqa: B023, E731
            fits = [i for i in range(len(words)) if share(i, width) >= 0.85 - 1e-9]
            mine = sorted((w, n, c) for w, n, b, c in got if b == label)
            assert all(n <= width and abs(share(w, n) - c) < 1e-12 and c >= 0.85 - 1e-9 for w, n, c in mine)
            assert all(w + n <= v for (w, n, _), (v, _, _) in zip(mine, mine[1:], strict=False))
            assert all(any(w < i + width and i < w + n for w, n, _ in mine) for i in fits)  # no block is far from a reported one
            hits += len(mine)
    assert hits > 300


def test_language_profiles_by_hand():
    keys = langid.gram_keys("Ab a!")
    c = lambda *x: sum(v << langid._BITS * (len(x) - 1 - k) for k, v in enumerate(x))
    none = (1 << langid._BITS) - 1
    a, b = ord("a"), ord("b")
    expected = [c(none, none, a)] * 2 + [c(none, none, b)] + [c(none, 0, a)] * 2 + [c(none, a, b), c(none, b, 0), c(none, a, 0)] + [c(0, a, b), c(a, b, 0), c(0, a, 0)]
    assert sorted(keys.tolist()) == sorted(expected)
    assert len(langid.gram_keys("12 !")) == 0


def test_language_distances_by_a_plain_version():
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["uno", "dos", "tres", "quatro"], "z": ["een", "twee", "drie", "vier"]}
    rng = random.Random(8)
    text_of = lambda lang, k: " ".join(rng.choice(words[lang]) for _ in range(k))
    train = {lang: text_of(lang, 200) for lang in words}
    n = 40
    profiles = {lang: langid.top_grams(t, n).tolist() for lang, t in train.items()}
    ranks = langid.Ranks(profiles, n)
    for _ in range(60):
        text = text_of(rng.choice("xyz"), rng.randrange(1, 6)) + rng.choice(["", " unknownword", " 12 !?"])
        own = langid.top_grams(text, n).tolist()
        far = {lang: sum(abs(p.index(g) - k) if g in p else n for k, g in enumerate(own)) for lang, p in profiles.items()}
        order = sorted(far, key=lambda lang: (far[lang], lang))
        best, second = order[:2]
        lang, score = ranks.predict(text)
        assert lang == best and abs(score - (far[second] - far[best]) / far[second]) < 1e-12


def test_language_accuracy(spark, sf_dir, docs):
    d = table(spark, sf_dir, "documents")
    got = langid.language_report(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("count(*) n", "avg(cast(lang = lang_pred as double)) share").collect()[0]
    assert got.n > 50 and got.share >= 0.97
    some = [(i, "the cat and the dog with the hat", "en", "s") for i in range(20)] + [(i, "der hund und die katze mit dem hut", "de", "s") for i in range(20, 40)]
    rows = langid.language_report(docs([*some, (90, None), (91, ""), (92, "123 !"), (93, "the hat and the cat", None, None)], extra=True)).collect()
    by = {r.doc_id: r for r in rows}
    assert by[90].lang_pred == by[91].lang_pred == by[92].lang_pred == "und" and by[90].score == 0
    assert by[93].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in langid.language_report(docs([(1, "abc", None, None)])).collect()] == ["und"]
    assert langid.language_report(docs([])).count() == 0


@pytest.mark.parametrize("text", ["", "a", "A b", "x" * 5000])
def test_top_grams_are_ordered(text):
    top = langid.top_grams(text)
    keys, counts = np.unique(langid.gram_keys(text), return_counts=True)
    n = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    order = [(-n[k], k) for k in top.tolist()]
    assert order == sorted(order)


@pytest.mark.parametrize("kind", ["query", "equals", "chain", "plus", "colon"])
def test_long_texts_without_quotes_are_read_in_linear_time(kind):
    rng = random.Random(kind)
    value = lambda n: "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(n))
    make = {
        "query": lambda n: "&".join(f"{rng.choice(['token', 'user', 'q', 'id'])}{i}={value(12)}" for i in range(n // 20)),
        "equals": lambda n: "=".join(value(6) for _ in range(n // 7)),
        "chain": lambda n: " = ".join(f"n{i}" for i in range(n // 9)) + ' = "x"',
        "plus": lambda n: "password = " + " + ".join(f'"{value(3)}"' for _ in range(n // 8)),
        "colon": lambda n: ":".join(f"name{i}" for i in range(n // 10)),
    }[kind]
    times = []
    for n in (125_000, 1_000_000):
        text = make(n)
        began = time.process_time()
        tracemalloc.start()
        spans, _ = secrets.scan_text(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        began = time.process_time()
        secrets.scan_text(text)
        times.append(time.process_time() - began)
    assert times[1] < 16 * times[0] + 0.5 and times[1] < (6 if kind == "colon" else 3) and peak < 250_000_000
    if kind == "query":
        assert len(spans) > 9000


def test_unquoted_values_end_where_the_next_pair_begins():
    text = "token=Q9x7LmP0sTq2&user=bob;secret=Zk83hsQpw01x,api_key=abcDEF123456==&x=1"
    assert {text[lo:hi] for lo, k, hi in secrets.scan_text(text)[0] if k == 3} == {"Q9x7LmP0sTq2", "Zk83hsQpw01x", "abcDEF123456=="}
    text = 'a = b = "Q9x7LmP0sTq2"\npassword = a'
    assert {text[lo:hi] for lo, k, hi in secrets.scan_text(text)[0] if k == 3} == {"Q9x7LmP0sTq2"}


def test_whole_licenses_are_found_in_comments_with_changes(docs):
    """A whole text behind comment marks, wrapped, with a name and a year in it and a tenth of its words changed; half of it, or its words far apart, is no license."""
    rng = random.Random(3)
    rows, want = [], {}
    for k, (label, text) in enumerate(licenses.WHOLE):
        words = text.split()
        changed = [w if rng.random() > 0.06 else "other" for w in words]
        wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(" ".join(changed), 70))
        rows += [(4 * k, f"code before\n/* Copyright 2020 A. Person\n{wrapped}\n*/\nint x;"), (4 * k + 1, " ".join(words[: len(words) // 2])), (4 * k + 2, " filler word here".join(words)), (4 * k + 3, " ".join(reversed(words)))]
        want[4 * k] = label
    counts = Counter(w for _, t in rows for w in licenses.words_of(t))
    index = licenses.TemplateIndex(licenses.WHOLE, counts, 0.85)
    found = {i: {licenses.WHOLE[m[2]][0] for m in index.matches(licenses.words_of(t))} for i, t in rows}
    for i, label in want.items():
        assert label in found[i] and label not in found[i + 1] | found[i + 2]
        assert label in found[i + 3]  # a block is a set of words
    labels = {r.doc_id: r.labels.split(",") for r in licenses.license_digest(docs(rows)).collect()}
    assert all(label in labels[i] for i, label in want.items())
