"""A small corpus with every hard case, and plain versions of the word rules."""

import random
import re

WORDS = {
    "en": "the and tion house river stone wind with over from light green morning walking water thing other".split(),
    "de": "der und schaft haus fluss stein wind mit über von licht grün morgen gehen wasser ding andere".split(),
    "fr": "le et tion maison rivière pierre vent avec sur de lumière vert matin marcher eau chose autre".split(),
}

# every column that an operator makes up, to clash with its own
CLASH = ["component_id", "kept", "score", "lang_pred", "size", "target", "taken", "n_lines", "spans", "term", "key",
         "pos", "line", "id", "n", "draws", "source_size", "drop", "row", "code", "bands", "f1", "shard", "named"]


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(40)) * (rng.random() < 0.6) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text, lang, source): plain documents, copies, near copies, and every hard case."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        rows.append([i, prose(rng, lang, rng.randrange(30, 90)) + "\n" + prose(rng, lang, 20), lang, f"s{i % 3}"])
    for i in range(60, 80):  # exact copies
        rows.append([i, rows[i - 60][1], rows[i - 60][2], "s0"])
    for i in range(80, 100):  # near copies: one word less
        w = rows[i - 80][1].split(" ")
        w.pop(rng.randrange(len(w)))
        rows.append([i, " ".join(w), rows[i - 80][2], "s1"])
    rows += [[100, None, "en", "s1"], [101, "", "en", None], [102, " \n\t ", None, "s2"], [103, "one", "en", "s2"],
             [104, "ONE", None, None], [105, "... 12 !!", "de", "s0"], [106, "word " * 30_000, "en", "s0"],
             [107, "".join(rng.choice("abcdef") for _ in range(200_000)), "en", "s2"], [108, None, None, None],
             [109, "naïve Σωκράτης 語 " * 3, "fr", "s2"], [None, rows[5][1], "en", "s1"], [None, None, None, None],
             list(rows[7]), list(rows[7]), [110, "two words", "en", "s1"]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def spaced(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s))


def alnum(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def classes(ids, links):
    """Smallest id reachable, by union-find."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]
