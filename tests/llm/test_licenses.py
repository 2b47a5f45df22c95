import re

import numpy as np
import regex

from tallyforge.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(both):
    got = licenses.detect(both, ("doc_id", "text")).collect()
    assert len(got) == both.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def accepted(text):
    low = text.lower().encode()
    start = np.array([m.start() for m in licenses._WORD.finditer(low)], np.int64)
    return [x[2] for x in licenses.scan(low, start)[1]]


def pattern(template):
    """The markup as a regular expression over words that are each followed by a blank."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^<\s]+", template):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<var"):
            out += "(?:[^ ]+ ){0,%d}" % int(part[6:-2])
        else:
            out += "".join(re.escape(w) + "[ .]" for w in part.split("."))
    return regex.compile(r"(?<![^ .])" + out, regex.POSIX)


def brute_labels(text):
    """By regular expressions: words are kept apart by a dot where only a dot is between two numbers, else by a blank."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    flat = "".join(w[0] + ("." if n and w[0].isdigit() and n[0].isdigit() and low[w.end() : n.start()] == "." else " ") for w, n in zip(words, [*words[1:], None], strict=True))
    return {name for name, template in licenses.TEMPLATES.items() if any(f[0].endswith(" ") for f in pattern(template).finditer(flat, overlapped=True))}


def spoilt(text, rng):
    words = text.split()
    k = int(rng.integers(len(words)))
    return " ".join([*words[:k], *(["other"] if rng.random() < 0.5 else []), *words[k + 1 :]])


def test_labels_equal_brute_force(docs):
    got = licenses.detect(docs, ("doc_id", "text")).collect()
    for r in got:
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | brute_labels(r.text)
    assert sum("apache-2.0" in r.labels for r in got) and not any("mit-text" in r.labels for r in got)


def test_whole_texts_and_spoilt_ones():
    rng = np.random.default_rng(1)
    for name, template in licenses.TEMPLATES.items():
        full = re.sub(r"<<(optional|end)>>", "", re.sub(r"<<var \d+>>", "the holders named", template))
        bare = re.sub(r"<<var \d+>>", "", template)
        while "<<optional>>" in bare:
            bare = re.sub(r"<<optional>>((?!<<).)*<<end>>", "", bare)
        for text in (full, bare, f"Some words. {full.upper()} and others"):
            assert name in accepted(text) and set(accepted(text)) == brute_labels(text), (name, text)
        for _ in range(20):
            for text in (spoilt(full, rng), spoilt(bare, rng)):
                assert set(accepted(text)) == brute_labels(text), (name, text)


def test_no_version_that_is_not_there():
    assert accepted("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert accepted("so it is LICENSED under the apache license") == []
    assert accepted("Licensed under the Apache License, Version 1.1") == []
    assert accepted("Licensed under the Apache License, Version 2.0.1") == []
    assert accepted("licensed under the terms of the GNU General Public License, version 3") == ["gpl-3.0"]
    assert accepted("licensed under the GNU General Public License version 3. 1 copy") == ["gpl-3.0"]
    assert accepted("licensed under the GNU General Public License version 2.1") == []
    assert accepted("licensed under the GNU General Public License version 2.0") == ["gpl-2.0"]
    assert accepted("licensed under the GNU Public License version 3") == []


def test_mandatory_wording_must_be_whole():
    text = licenses.TEMPLATES["mit-text"].replace("<<optional>> including the next paragraph <<end>>", "").replace("<<var 12>>", "{}")
    assert accepted(text.format("the authors or copyright holders")) == ["mit-text"]
    assert accepted(text.format("")) == ["mit-text"]
    assert accepted(text.format(" ".join(["x"] * 12))) == ["mit-text"]
    assert accepted(text.format(" ".join(["x"] * 13))) == []
    assert accepted(text.format("x").partition("subject to")[0]) == []
    assert accepted(text.format("x").replace("without restriction", "without restriction but you must pay")) == []


def test_longest_run_is_taken():
    low = b"licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"
    start = np.array([m.start() for m in licenses._WORD.finditer(low)], np.int64)
    assert licenses.scan(low, start)[1] == [(0, len(start), "apache-2.0")]


def test_empty(none, odd):
    assert licenses.detect(none).count() == 0
    assert licenses.detect(odd).count() == odd.count()
