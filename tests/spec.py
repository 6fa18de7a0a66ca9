"""Plain executable specification of segmentation and greedy translation, for tests only."""

import re

ASCII_SPACE = "\t\n\x0b\x0c\r "
ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "prof", "sr", "jr", "etc", "e.g", "i.e", "vs"}


def lookup(x):
    x = x.lower()
    for a, b in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')):
        x = x.replace(a, b)
    for p, r in ((r"\bcan't\b", "cannot"), (r"\bwon't\b", "will not"), (r"\bn't\b", " not"), (r"\bi'm\b", "i am"), (r"\b(\w+)'re\b", r"\1 are"), (r"\b(\w+)'ll\b", r"\1 will"),
                 (r"\b(\w+)'ve\b", r"\1 have"), (r"\b(\w+)'d\b", r"\1 would"), (r"\b(\w+)'s\b", r"\1")):
        x = re.sub(p, r, x, flags=re.A)
    x = re.sub(r"[.,;:!?()\[\]{}\"']", " ", x)
    x = re.sub(r"(?<=[^\W\d_])-(?=[^\W\d_])", " ", x)
    return re.sub(r"\s+", " ", x, flags=re.A).strip()


def segments(text):
    out, current, i = [], "", 0
    while i < len(text):
        c = text[i]
        left = re.split(r"\s+", text[:i].strip(), flags=re.A)
        ends = c in ".!?" and not (c == "." and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()) and not (c == "." and left[-1].lower() in ABBREVIATIONS)
        if ends:
            j = i + 1
            while j < len(text) and text[j] in ".!?\"')]}":
                j += 1
            out.append((current.strip(), text[i:j]))
            current, i = "", j
        else:
            current, i = current + c, i + 1
    if current.strip() or not out:
        out.append((current.strip(), ""))
    return out


def greedy(text, table):
    """(translation, matched, type, consumed) of one segment; ``table`` maps phrases to translations."""
    w = [x for x in lookup(text).split(" ") if x]
    if not w:
        return "", "", "none", 0
    tokens = re.findall(r"[^\W_][\w'’-]*", text)

    def best(pos):
        for n in range(min(12, len(w) - pos), 0, -1):
            part = w[pos:pos + n]
            short = [x for x in part if x not in ("a", "an", "the", "please", "just")]
            for variant, phrase in enumerate([" ".join(part)] + ([" ".join(short)] if 2 <= len(short) < n else [])):
                if phrase in table:
                    kind = "full" if (pos, n, variant) == (0, len(w), 0) else ("phrase" if n > 1 else "word") + ("-normalized" if variant else "")
                    return n, phrase, table[phrase], kind
        return None

    hit = best(0)
    if hit and hit[0] == len(w):
        return hit[2], hit[1], "full", hit[0]
    parts, meta, pos = [], ("", "none", 0), 0
    while pos < len(w):
        hit = best(pos)
        if hit:
            meta = (hit[1], hit[3], hit[0]) if meta[1] == "none" else meta
            parts.append(hit[2])
            pos += hit[0]
        else:
            parts.append(tokens[pos] if len(tokens) == len(w) else w[pos])
            pos += 1
    return (" ".join(parts), *meta)
