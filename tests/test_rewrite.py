import base64
import random
import re
from urllib.parse import quote, quote_plus

import pytest

from assetloom.functions.rewrite import MASK, REGISTRY, WARNING, spelled, unpack

PROGRAM = "function greet(who) { return 'hi ' + who + '\\\\n'; } greet(window.user); total = total + 1;"
FUNCTION = "eval(function(p,a,c,k,e,d){while(c--){if(k[c]){p=p.replace(new RegExp(c.toString(a),'g'),k[c])}}return p}("


def pack(source, base, shown=None, keep=()):
    """A packer of our own: each word becomes its number, most frequent first; words in keep stand for themselves by an empty name."""
    words = sorted(set(re.findall(r"\w+", source)))
    random.Random(base).shuffle(words)
    for word in keep:
        words = [w for w in words if w != word]
    names = list(words)
    for word in sorted(keep, key=lambda w: [spelled(n, base) for n in range(200)].index(w)):
        names.insert([spelled(n, base) for n in range(200)].index(word), "")
    number = {w: spelled(n, base) for n, w in enumerate(names) if w} | {w: w for w in keep}
    payload = re.sub(r"\w+", lambda m: number[m[0]], source).replace("\\", "\\\\").replace("'", "\\'")
    return f"{FUNCTION}'{payload}',{shown or base},{len(names)},'{'|'.join(names)}'.split('|'),0,{{}}))"


def kinds(text):
    return [u.name for u in REGISTRY if u.detect(text)]


@pytest.mark.parametrize("base, shown", [(10, None), (16, None), (36, None), (62, None), (62, "[]")])
def test_packed_code_comes_back(base, shown):
    packed = pack(PROGRAM, base, shown)
    assert kinds(packed) == ["packer"] and unpack(packed) == PROGRAM
    assert unpack(f"before(); {packed}; after('x')") == f"before(); {PROGRAM}; after('x')"


def test_a_word_without_a_name_stands_for_itself():
    assert unpack(pack("a1 = 0 + b2", 36, keep=("0",))) == "a1 = 0 + b2"


def test_packed_code_with_a_table_of_strings():
    source = 'var _cfg=["first","second"];call(_cfg[1],_cfg[0])'
    assert unpack(pack(source, 62)) == 'call("second","first")'


@pytest.mark.parametrize("change", [lambda t: t.replace(",36,10,'", ",36,11,'"), lambda t: t[:-30], lambda t: t.replace(".split", "|more.split", 1).replace("'|more", "|more'"), lambda t: t.replace("',36,", "',90,")])
def test_damaged_code_stays_as_it_was(change):
    broken = change(pack(PROGRAM, 36))
    assert broken != pack(PROGRAM, 36) and unpack(broken) == broken


def test_numbers_are_spelled_like_the_language_does():
    assert all(int(spelled(n, b), b) == n for b in (2, 10, 16, 36) for n in range(300))
    assert len({spelled(n, 62) for n in range(5000)}) == 5000 and spelled(61, 62) == "Z" and spelled(94, 95) == "~"


def test_tables_of_strings():
    text = 'var _0xfe01=["to\\"p","it\'s"];open(_0xfe01[0]);shut(_0xfe01[1],_0xfe01[7],my_0xfe01[0]);'
    assert kinds(text) == ["array"]
    assert unpack(text) == 'open("to\\"p");shut("it\'s",_0xfe01[7],my_0xfe01[0]);'
    assert unpack("var _0x77=[];rest();") == "rest();"
    assert kinds("let _0x77=[];") == kinds("x();var _0x77=[];") == []


def test_percent_escapes():
    for source in ("let total = price * 2; show(total)", "if (a && b) { run('x y') }"):
        for spell in (quote, quote_plus):
            assert unpack(spell(source)) == (source if "%20" in spell(source) or spell(source).count("%") > 3 else spell(source))
    for plain in ("", "x=50%2", "let a = '%20%20%20%20'"):
        assert kinds(plain) == [] and unpack(plain) == plain


def test_masked_code():
    hidden = base64.b64encode(quote("var _escape='<script>steal(42)</script>';").encode()).decode()[::-1]
    text = f"var names={MASK};var kept='{hidden}';eval(open1(turn(kept)));"
    assert kinds(text) == ["masked"] and unpack(text) == WARNING + "steal(42)"
    other = text.replace("eval(open1(turn(kept)));", "")
    assert unpack(other) == other
