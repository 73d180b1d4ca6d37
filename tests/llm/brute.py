"""Plain versions of the contracts, one document at a time."""

import collections
import hashlib
import itertools
import re

BLANK = r"\x20\x09-\x0D"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(f"[^{BLANK}]+", text or "")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    """(start, kind's place, end, kind) of confirmed base spans."""
    out = []
    for place, (kind, pattern) in enumerate(KINDS.items()):
        if kind == "email" and "@" not in (text or ""):
            continue
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


#: Kinds beyond the base ones, written out anew: pattern, first score, words for it and against it.
ADDED = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+", 60, "iban|bank|account|konto|compte|cuenta", "serial|article"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 30, "ssn|social|security|tax", "serial|order|part|isbn|invoice"),
    ("secret", r"(?i)(?<![A-Za-z0-9])(?:(?:api|access|auth|client|private|secret)[_-]?key|(?:[a-z]{1,16}[_-])?(?:token|secret)|password|passwd|pwd)[\"']?[ \t]?[:=][ \t]?[\"']?[a-z0-9+/_.~=-]{8,}[\"']?", 60, "config|deploy|login|env|auth", "$^"),
)
MADE_UP = r"(?<![@.\w])(?:example|sample|dummy|placeholder|fake|specimen)(?![.@\w])"


def iban_end(match):
    """How much of a match is a number that passes, by the length of its country; Germany and Britain only."""
    want, plain = {"DE": 22, "GB": 22}.get(match[:2], 0), ""
    for k, c in enumerate(match):
        plain += c.strip()
        if len(plain) == want:
            if k + 1 < len(match) and match[k + 1] != " ":
                return 0
            number = int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4]))
            return k + 1 if number % 97 == 1 else 0
    return 0


def added_spans(text):
    """(start, end, kind) of the added kinds that the small tables hold."""
    out, text = [], text or ""
    for kind, pattern, score, near, against in ADDED:
        found = []
        for m in re.finditer(pattern, text, re.ASCII):
            end = m.end()
            if kind == "iban":
                size = iban_end(m[0])
                end = m.start() + size
                if not size:
                    continue
            if kind == "ssn" and (m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][-4:] == "0000"):
                continue
            found.append((m.start(), end))
        for k, (a, b) in enumerate(found):
            low, high = found[k - 1][1] if k else 0, found[k + 1][0] if k + 1 < len(found) else len(text)
            around = (text[max(low, a - 40) : a] + " " + text[b : min(high, b + 40)]).lower()
            value = re.sub("^[^:=]*", "", text[a:b])
            if kind == "secret" and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
                continue
            if score + 30 * bool(re.search(near, around)) - 30 * bool(re.search(against, around)) - 30 * bool(re.search(MADE_UP, around, re.ASCII)) >= 50:
                out.append((a, ["iban", "ssn", "secret"].index(kind), b, kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(sets):
    """id -> least id reachable over links of similarity 0.75."""
    posting, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for g in s:
            posting[g].append(i)
    for ids in posting.values():
        common.update(itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Reshare what is over the caps, turn by turn."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, fixed = budget * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
        left = budget * sum(sizes.values()) - sum(fixed.values())
