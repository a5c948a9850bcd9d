"""Column functions: text in, arrays of offsets, sentences, scopes or sections out. None runs Python on rows."""
