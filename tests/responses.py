"""A generator of response texts of eleven kinds, and a plain-Python reading of them."""

import re

from plumbline.taxonomy import load_taxonomy

TAX = load_taxonomy("safewatch")
KINDS = "good good good good_upper short_keys asterisk partial think_leak no_answer empty_answer trailing garbage empty".split()


def block(decisions, key, upper=False):
    lines = (f'"{key(i)}": {str(v) if upper else str(v).lower()}' for i, v in decisions.items())
    return "GUARDRAIL: {\n" + ",\n".join(lines) + "\n}"


def response(rng, fmt, truth):
    """(text, kind); predictions follow the truth but for a quarter of all flags."""
    d = {i: (i in truth) != (rng.random() < 0.25) for i in TAX.ids}
    kind = rng.choice(KINDS)
    if kind == "partial":
        keep = set(rng.sample(TAX.ids, rng.randint(1, len(TAX) - 1)))
        d = {i: v for i, v in d.items() if i in keep}
    body = block(d, str if kind == "short_keys" else TAX.output_key, kind == "good_upper")
    if kind == "asterisk":
        body = "\n".join(f"* {TAX.output_key(i)}: {str(v).lower()}" for i, v in d.items())
    thought = "A person walks." + (" Draft: " + block({i: not v for i, v in d.items()}, TAX.output_key) if kind == "think_leak" else "")
    if kind in ("garbage", "empty"):
        return {"garbage": "I cannot tell.", "empty": ""}[kind], kind
    if fmt == "think_answer":
        if kind == "no_answer":
            return f"<think>{thought}</think>\n{body}", kind
        text = f"<think>{thought}</think>\n<answer>{'No decision.' if kind == 'empty_answer' else body}</answer>"
        return text + "\nThanks!" * (kind == "trailing"), kind
    gap = "\n" if kind == "no_answer" else "\n\n\n"
    return thought + gap + ("No decision." if kind == "empty_answer" else body), kind


def read(text, fmt, scope):
    """(status, decisions, labels) of a text, the plain way."""
    answer = None
    if fmt == "think_answer" and (m := re.search(r"<answer>(.*?)</answer>", text, re.S | re.I)):
        answer = m[1].strip()
    if fmt == "triple_newline" and "\n\n\n" in text:
        answer = text.split("\n\n\n", 1)[1].strip()
    target = answer if scope == "answer_only" else answer if scope == "answer_or_full" and answer is not None else text
    none = dict.fromkeys(TAX.ids)
    if target is None:
        return "invalid", none, None
    for lead in (lambda i: '"' + re.escape(TAX.output_key(i)) + '"', lambda i: '"' + i + '"', lambda i: r"\*\s*" + re.escape(TAX.output_key(i))):
        found = {i: m[1].lower() == "true" for i in TAX.ids if (m := re.search(lead(i) + r":\s*(true|false)", target, re.I))}
        if found:
            d = none | found
            return "ok" if len(found) == len(TAX) else "partial", d, [i for i in TAX.ids if d[i]]
    return "invalid", none, None
