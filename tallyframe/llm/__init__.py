"""Operators for building language-model training corpora over the ``documents`` table and friends.

Nothing else in the library imports this package.  One module per operator, plus ``common``
(helpers), ``components`` (connected components), ``wordcache`` (per-worker vocabulary cache) and
``queries`` (the registered queries and their SQL).
"""
