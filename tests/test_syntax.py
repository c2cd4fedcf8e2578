import pytest

from ravelin.functions.pysource import analyze

SPLIT = [
    "a='ev'\nb='al'\nx=a+b", "x=f\"{'ex'}{'ec'}\"", "p='sys'\nq='%stem' % p", "x='{}{}'.format('po','pen')", "x=''.join(map(chr,[101,118,97,108]))", "x=''.join(reversed('lave'))",
    "def f():\n  return 'ev'\nx=f()+'al'", "class A:\n  a='ev'\n  def r(self):\n    return self.a+'al'", "d={}\nd['k']='ex'\nx=d['k']+'ec'", "x='eXYl'.replace('X','va').replace('Y','')",
    "import functools,operator\nx=functools.reduce(operator.add,['sy','stem'])", "import os\nos.__dict__['system']('x')", "globals()['__builtins__']['eval']('1')", "x=bytearray(b'eval').decode()",
    "t=''\nfor c in ['ev','al']:\n  t+=c\ny=t+''", "if (a:='ev') and (b:='al'):\n  x=a+b", "import builtins\n@builtins.exec\nclass A: pass", "import subprocess as s\no={}\no|={'shell':1}\ns.run(['l'],**o)",
    "a='ev'\nb='al'\nc='%s%d' % (a, b)", "a='ev'\nb='al'\nc='%f%s' % (a, b)", "a='ex'\nb='ec'\nc='%x%s' % (a, b)", "a='sy'\nb='st'\nc='em'\nd='%s%d%r' % (a, b, c)", "a='eval'\nc='%d' % a", "a='__im'\nb='port__'\nc='%s%d' % (a, b)",
    "a='po'\nb='pen'\nc='%d%s' % (a, b)", "d={'t':'eval','o':'print'}\nn=d.pop('t')\nglobals()[n]('1')", "import subprocess\nsubprocess.run(['l'],**{'shell':-1.0})",
    "m=__import__('os')\nm.system('x')", "import importlib\nf=getattr(importlib.import_module('os'),'popen')\nf('x')", "a='aW1wb3J0IG9zOyBvcy'\nb='5zeXN0ZW0oJ2NtZCcp'\nx=a+b",
]
SAFE = [
    "a='ev'\nb='al'\nc='x'\nd='%s' % (a, b, c)", "a='eval'\nc='%%s' % a", "import subprocess\no={}\no.update(shell=True)\nsubprocess.run(['l'],**o)", "a='ev'\nb='al'\nx='{0}{n}'.format(a, n=b)", "f='{}{}'\nx=f.format('ev','al')",
    "s='xevalx'\ni=1\nx=s[i:5]", "import subprocess\nsubprocess.run(['l'],**{'shell':0.0})", "x=''\nfor c in 'a' * 2000:\n  x+=c",
    "a='hel'\nb='lo'\nx=a+b", "x='eval'", "globals()['config']", "def f(**k):\n  g(**k)", "import subprocess\nsubprocess.run(['ls'],**{**b,'shell':True})", "x='hello world'[2:6]", "import subprocess\nsubprocess.run(['ls'],**{'shell':0})"]


@pytest.mark.parametrize("source", SPLIT)
def test_hidden_names_are_found(source):
    assert {r[0] for r in analyze(source)} & {"EXEC-002", "EXEC-006"}


@pytest.mark.parametrize("source", SAFE)
def test_harmless_sources(source):
    assert not analyze(source)


@pytest.mark.parametrize(
    "source, rule, severity",
    [
        ("import os as o\no.system('x')", "EXEC-002", "critical"),
        ("from os import *\npopen('x')", "EXEC-002", "critical"),
        ("import subprocess\nsubprocess.run('x', shell=True)", "EXEC-002", "critical"),
        ("import pickle\npickle.loads(x)", "EXEC-007", "critical"),
        ("import yaml\nyaml.load(x)", "EXEC-007", "critical"),
        ("getattr(o, 'ev'+'al')", "EXEC-006", "high"),
        ("import os\ngetattr(os, name)", "EXEC-006", "medium"),
        ("().__class__.__bases__[0].__subclasses__()", "EXEC-011", "high"),
        ("f.__init__.__globals__['x'].__class__.__mro__", "EXEC-011", "critical"),
        ("import codecs\ncodecs.decode(x, 'rot13')", "OBFS-001", "high"),
        ("def r(s):\n  return ''.join(chr((ord(c)-97+13)%26+97) if c.islower() else chr((ord(c)-65+13)%26+65) for c in s)", "OBFS-001", "high"),
        ("import subprocess\nsubprocess.run(['/usr/bin/curl', u])", "EXFIL-008", "critical"),
        ("import socket\nsocket.getaddrinfo(d + '.x', 80)", "EXFIL-006", "critical"),
        ("def c(s):\n  return [chr((ord(x)-ord('a')+7)%26+ord('a')) if 'a'<=x<='z' else chr((ord(x)-ord('A')+7)%26+ord('A')) for x in s]", "OBFS-001", "high"),
        ("from socket import *\ngetaddrinfo(f'{data}.in.example', 80)", "EXFIL-006", "critical"),
        ("def (", "AST-PARSE", "info"),
    ],
)
def test_calls(source, rule, severity):
    assert (rule, severity) in {r[:2] for r in analyze(source)}


def test_what_is_safe_stays_so():
    assert not analyze("import yaml\nyaml.load(x, Loader=yaml.SafeLoader)")
    assert not analyze("import subprocess\nsubprocess.run(['nc', 'a'])")
    assert not analyze("import socket\nsocket.getaddrinfo('a.example', 80)")
    assert not analyze("x.__class__.__name__")
