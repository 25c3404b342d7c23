"""Small inline inputs for operators that the given tables have nothing for."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.embedding import StaticModel

SOURCES = {
    "src/box.ts": "import { a } from './a'\nimport './side'\n\nexport class Box {\n  // not a brace: {\n  open() {\n    return '}'\n  }\n}\n\nexport function make(n: number) {\n  if (n > 0) {\n    return new Box()\n  }\n  return null\n}\n\nexport const LIMIT = 3\n",
    "lib/tool.py": "import os\nfrom pathlib import Path\n\n\nclass Tool:\n    def run(self):\n        return os.getcwd()\n\n\ndef main():\n    tool = Tool()\n\n    return tool.run()\n",
    "cmd/main.go": 'package main\n\nimport "fmt"\n\ntype Point struct {\n\tX int\n}\n\nfunc (p Point) Show() {\n\tfmt.Println(p.X)\n}\n',
    "src/lib.rs": "use std::fmt;\n\npub struct Pair(u8, u8);\n\npub trait Named {\n    fn name(&self) -> String;\n}\n\npub fn add(a: u8, b: u8) -> u8 {\n    return a + b;\n}\n",
    "src/util.c": '#include <stdio.h>\n#define MAX 10\n\nstruct node {\n  int v;\n};\n\nint twice(int x)\n{\n  return 2 * x;\n}\n',
    "app/View.swift": "import UIKit\n\nclass View {\n  func draw() {\n    return\n  }\n}\n",
    "lib/empty.rb": "class Thing\nend\n",
}
#: Six lines of code by extension, which code of any length repeats; ``@`` is the line's number, ``~`` words of a document.
CODE = {
    "ts": ["// ~", "export class C@ {", "  m@(x) { return `${x ? `}` : '{'}{` } // ~", "  p@ = /[{/'`]\\/\"{/g // ~", "}", "import { a } from './w@'"],
    "py": ["# ~", "class C@:", "    def m@(self): # ~", "        return '~'", "", "from mod@ import a"],
    "go": ["// ~", "type C@ struct {", "    x int // ~", "}", "func F@() { return } // ~", 'import "pkg/w@"'],
    "rs": ["// ~", "pub struct S@(u8);", "pub fn f@<'a>(a: &'a u8) -> u8 {", "    a // '{' ~", "}", "use std::w@;"],
    "c": ["/* ~ */", "#define M@ 10", "int g@(int x)", "{ // ~", "}", "#include <h@.h>"],
    "swift": ["// ~", "class K@ {", "  func d@() { return } // ~", "}", "protocol P@ {}", "import W@"],
}
#: Symbols of these lines: extension, line, kind, letter of the name, lines to the end (-1: none; -2: as indentation has it).
CODE_SYMBOLS = [("ts", 1, "class", "C", 3), ("py", 1, "class", "C", -2), ("go", 1, "class", "C", 2), ("go", 4, "function", "F", 0), ("rs", 1, "class", "S", -1), ("rs", 2, "function", "f", 2)]
CODE_SYMBOLS += [("c", 1, "define", "M", -1), ("c", 2, "function", "g", 2), ("swift", 1, "class", "K", 2), ("swift", 2, "function", "d", 0), ("swift", 4, "interface", "P", 0)]
#: What the sixth line imports.
CODE_IMPORTS = {"ts": "./w@", "py": "mod@", "go": "pkg/w@", "rs": "std::w@", "c": "h@.h", "swift": "W@"}
AGENTS = [
    (None, None, ""), ("curl/8.1", "v1.2", "?key=abc&q=1"), ("Mozilla/5.0 (X11)", "main", "?q=2"), ("Mozilla/5.0 GPTBot/1.0", "0123456789abcdef0123456789abcdef01234567", ""), ("python-requests/2", "1.0.0", "?token=x"),
    ("SomeScraper/1", "feature/x", "?q=" + "z" * 200), ("PerplexityBot", "", ""), ("Something", "v2", ""), ("Googlebot/2.1", "2.5", ""),
]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES.items()), "path string, text string")


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGENTS, "agent string, ref string, query string")


QUESTIONS = ["Where is `max_retries = 3` set in parseConfig?", 'which file has "hello world" and src/util/math.ts', "how are snapshots evicted after seven days", "", "MAX_SIZE of HttpClient's buffer_pool"]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q in QUESTIONS], "question string")


#: Words that a small model has vectors for.
MODEL_WORDS = "en in the of on and to a is be as that er it re was for an with this are by from at or de la que des un elle les pour par dans license version under public work".split()
MODEL_WIDTH = 8


def small_model() -> StaticModel:
    """A model of whole words whose weights their checksums decide."""
    weights = [[zlib.crc32(f"{w}:{j}".encode()) % 255 - 127 for j in range(MODEL_WIDTH)] for w in MODEL_WORDS]
    return StaticModel({w: i for i, w in enumerate(MODEL_WORDS)}, np.ones(len(MODEL_WORDS), np.float32), np.array(weights, np.int8))
