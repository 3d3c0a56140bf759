"""License rules: gates lose nothing, every signature is found by itself, expressions name each of their operands once."""

import random
import re
import re._constants as C
import re._parser as P

import pytest

from fluvia.llm import licenses


def _example(parsed, rng: random.Random) -> str:
    """A random string that a parsed pattern matches; looks around are left out."""
    out = []
    for op, arg in parsed:
        if op is C.LITERAL:
            out.append(chr(arg))
        elif op is C.ANY:
            out.append("q")
        elif op is C.IN:
            kind, what = rng.choice(arg)
            out.append(chr(what if kind is C.LITERAL else rng.randint(*what)))
        elif op is C.SUBPATTERN:
            out.append(_example(arg[3], rng))
        elif op is C.BRANCH:
            out.append(_example(rng.choice(arg[1]), rng))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, part = arg
            out.extend(_example(part, rng) for _ in range(rng.randint(low, min(int(high), low + 2))))
        else:
            assert op in (C.ASSERT, C.ASSERT_NOT), op
    return "".join(out)


def test_gates_lose_nothing():
    scanner, rng = licenses.Scanner(), random.Random(5)
    for rule in scanner.rules:
        for n in range(4):
            text = f" some {_example(P.parse(rule.pattern.pattern), rng)} words "
            assert rule.pattern.search(text), (rule.pattern.pattern, text)
            seen = {k for _, k in scanner.gates.iter(text)}
            assert seen & rule.keywords and seen & rule.names, (rule.pattern.pattern, text)
            assert n or scanner.detections(text) == licenses.suppressed(licenses.detected(scanner.rules, text)), text
            assert any(k in text.encode() for k in scanner.first), text


@pytest.mark.parametrize("signature", licenses.TEXTS, ids=lambda s: s[3][:40])
def test_each_signature_is_found(signature, scanner=licenses.Scanner()):
    rng = random.Random(7)
    text = _example(P.parse(signature[3]), rng)
    found = scanner.scan(f"Words before. {text.upper()}; and more.")
    family = re.split(r"-[0-9]", signature[2])[0]
    assert any(x == signature[2] or x.startswith(family) for x in found[5].split(",")), (text, found)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3-or-later"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2,mit"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "classpath-exception,gpl-2-only"),
        ("SPDX-License-Identifier: MIT AND BSD-3-Clause AND Zlib", "bsd-3-clause,mit,zlib"),
        ("SPDX-License-Identifier: MIT\nand then ISC style", "mit"),
        ("the elastic license plate", ""),
        ("the elastic license 2.0", "elastic-2"),
        ("", ""),
    ],
)
def test_expressions(text, labels, scanner=licenses.Scanner()):
    assert scanner.scan(text)[5] == labels
