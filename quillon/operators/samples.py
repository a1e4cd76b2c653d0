"""Small sources in ten languages, with the symbols that line patterns find in them: (name, kind, scope, line)."""

SOURCES: dict[str, tuple[str, tuple[tuple[str, str, str, int], ...]]] = {
    "go": (
        "package shop\n\nconst Limit = 5\n\ntype Cart struct {\n\tOwner string `json:\"owner\"`\n}\n\ntype Buyer interface {\n}\n\nfunc (c *Cart) Total() int {\n}\n\nfunc open(n int) {\n}\n",
        (("shop", "package", "", 1), ("Limit", "constant", "", 3), ("Cart", "struct", "", 5), ("Owner", "field", "", 6), ("Buyer", "interface", "", 9), ("Total", "method", "Cart", 12), ("open", "function", "", 15)),
    ),
    "python": (
        "import os\nfrom sys import path\n\nLIMIT = 5\n\nclass Cart:\n    def total(self):\n        pass\n\ndef open(n):\n    pass\n",
        (("os", "import", "", 1), ("sys", "import", "", 2), ("LIMIT", "variable", "", 4), ("Cart", "class", "", 6), ("total", "method", "", 7), ("open", "function", "", 10)),
    ),
    "javascript": (
        'import { a } from "./lib.js"\n\nexport const LIMIT = 5\nlet count = 0\n\nexport class Cart {\n  total(x) {\n  }\n}\n\nfunction open(n) {\n}\n',
        (("./lib.js", "import", "", 1), ("LIMIT", "constant", "", 3), ("count", "variable", "", 4), ("Cart", "class", "", 6), ("total", "method", "", 7), ("open", "function", "", 11)),
    ),
    "typescript": (
        "export interface Buyer {\n}\n\ntype Price = number\n\nexport enum Kind {\n}\n\nexport class Cart {\n}\n\nexport function open(n) {\n}\n",
        (("Buyer", "interface", "", 1), ("Price", "type", "", 4), ("Kind", "enum", "", 6), ("Cart", "class", "", 9), ("open", "function", "", 12)),
    ),
    "java": (
        "package com.shop;\n\nimport java.util.List;\n\npublic class Cart {\n    private int size = 0;\n    public int total() {\n    }\n    void open(int n) {\n    }\n}\n\ninterface Buyer {\n}\n",
        (("com.shop", "package", "", 1), ("java.util.List", "import", "", 3), ("Cart", "class", "", 5), ("size", "field", "", 6), ("total", "method", "", 7), ("Buyer", "interface", "", 13)),
    ),
    "rust": (
        "use std::fmt\n\npub const LIMIT: u8 = 5;\n\npub struct Cart {\n}\n\ntrait Buyer {\n}\n\nenum Kind {\n}\n\nimpl Cart {\n    pub fn total(&self) {\n    }\n}\n\nfn open(n: u8) {\n}\n",
        (("std::fmt", "import", "", 1), ("LIMIT", "constant", "", 3), ("Cart", "struct", "", 5), ("Buyer", "trait", "", 8), ("Kind", "enum", "", 11), ("total", "method", "", 15), ("open", "function", "", 19)),
    ),
    "c": (
        "#define LIMIT 5\n\nstruct Cart {\n};\n\ntypedef int Price;\n\nenum Kind {\n};\n\nstatic int open(int n) {\n}\n",
        (("LIMIT", "constant", "", 1), ("Cart", "struct", "", 3), ("Price", "type", "", 6), ("Kind", "enum", "", 8), ("open", "function", "", 11)),
    ),
    "c++": (
        "namespace shop {\n\nclass Cart {\n};\n\nint Cart::total() {\n}\n\nint open(int n) {\n}\n}\n",
        (("shop", "module", "", 1), ("Cart", "class", "", 3), ("total", "method", "Cart", 6), ("open", "function", "", 9)),
    ),
    "ruby": (
        'require "set"\n\nmodule Shop\nend\n\nclass Cart\n  attr_reader :owner\n\n  def total?\n  end\nend\n\ndef open(n)\nend\n\nLIMIT = 5\n',
        (("set", "import", "", 1), ("Shop", "module", "", 3), ("Cart", "class", "", 6), ("owner", "property", "", 7), ("total?", "method", "", 9), ("open", "function", "", 13), ("LIMIT", "constant", "", 16)),
    ),
    "php": (
        "namespace App\\Shop;\n\nuse App\\Lib;\n\ninterface Buyer {\n}\n\nabstract class Cart {\n    public function total() {\n    }\n}\n\nfunction open($n) {\n}\n\ndefine('LIMIT', 5);\n",
        (("App\\Shop", "module", "", 1), ("App\\Lib", "import", "", 3), ("Buyer", "interface", "", 5), ("Cart", "class", "", 8), ("total", "method", "", 9), ("open", "function", "", 13), ("LIMIT", "constant", "", 16)),
    ),
}
