"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it; its queries are listed in
``quillpack.llm.queries``.
"""
