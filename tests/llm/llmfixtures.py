"""Texts that every operator over documents must handle."""

#: Null, empty, white space, one word, a repeated text, and a very long one.
ODD = [None, "", " \n\t", "one", "one", "a b", "wörd ß " * 3, "zwölf 東京 🙂 été " * 20000]
