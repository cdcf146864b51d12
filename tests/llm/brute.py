"""Rows with awkward values, and plain versions of what the operators compute."""

import math
import random
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\f\r"
VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return (text or "").encode().split()


def folded(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward():
    """(doc_id, text): copies, near copies, shared passages, null and empty texts, odd blanks, a very long text, null ids."""
    base = prose(1, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    passage = prose(2, 60)
    rows = [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, "  ".join(base).upper()),
        (4, " ".join(near)),
        (5, f"{prose(3, 40)} {passage} {prose(4, 30)}"),
        (6, f"{prose(5, 20)}\n{passage}\t{prose(6, 25)}"),
        (7, None),
        (8, ""),
        (9, " \t\n "),
        (10, "one two three"),
        (11, "one two three"),
        (12, "one\x0btwo\fthree\r"),
        (13, "é" * 50 + " nbsp inside  double"),
        (14, prose(7, 30_000)),
        (15, "same same same same same same same same same same same same same same same same same same same same same same same"),
        (16, passage),
    ]
    return rows


def frame(spark, rows, extra=True):
    """The rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("key", "size", "block", "_row", "_site", "line", "lines", "component", "_copy", "rank", "source", "rep")})
    return df


def suffix_tree(rows, held_out, least, least_entry, depth, smoothing):
    """id -> log10 probability of its text, from a suffix tree in dictionaries; ``rows``: (id, text) with distinct ids."""
    texts = {i: folded(t) for i, t in rows}
    train = [w for i, w in texts.items() if not held_out(i)]
    counts = Counter(x for w in train for x in w)
    symbols = {x for x, c in counts.items() if c >= least}
    rare = {x: c for x, c in counts.items() if x not in symbols}
    rare_tokens, once = sum(rare.values()), sum(c == 1 for c in rare.values())
    discount = min(0.9, once / len(rare)) if rare else 0.0
    unknown = max(discount * len(rare) / rare_tokens if rare else 1.0, 1e-12)
    tokens = sum(counts.values()) + len(train)

    def stream(w):
        return ["<begin>", *[x if x in symbols else "<rare>" for x in w], "<end>"]

    root = Counter(x for w in train for x in stream(w)[1:])

    def at_root(symbol):
        return (root[symbol] + 0.5) / (tokens + 0.5 * (len(symbols) + 2))

    kept = {}  # context -> (probabilities of its entries, what it leaves to its suffix)

    def chance(context, symbol):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return at_root(symbol)
        entries, left = kept[context]
        return entries[symbol] if symbol in entries else left * chance(context[1:], symbol)

    for length in range(1, depth + 1):
        following = defaultdict(Counter)
        for w in train:
            s = stream(w)
            for k in range(length, len(s)):
                following[tuple(s[k - length : k])][s[k]] += 1
        found = {}
        for context, after in following.items():
            total = sum(after.values())
            if total < least or (length > 2 and context[1:] not in kept):
                continue
            taken = {x: c for x, c in after.items() if c >= least_entry}
            rest, wider = total - sum(taken.values()), {x: chance(context[1:], x) for x in taken}
            gain = sum(c * math.log(c / total / wider[x]) for x, c in taken.items())
            if rest:
                gain += rest * math.log(rest / total / max(1e-9, 1 - sum(wider.values())))
            if gain > 0.5 * (len(taken) + 1) * math.log(total):
                left = (smoothing + rest) / (total + smoothing)
                found[context] = ({x: c / (total + smoothing) + left * wider[x] for x, c in taken.items()}, left)
        if not found:
            break
        kept.update(found)

    def scored(w):
        s, out = stream(w), 0.0
        for k in range(1, len(s)):
            out += math.log10(chance(tuple(s[max(0, k - depth) : k]), s[k]))
            if s[k] == "<rare>":
                x = w[k - 1]
                out += math.log10(max(rare[x] - discount, 1e-12) / rare_tokens if x in rare else unknown)
        return out

    return {i: scored(w) for i, w in texts.items()}, kept
