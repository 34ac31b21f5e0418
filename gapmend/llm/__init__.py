"""Training-data operators over a table of documents (doc_id, text, lang, source, n_chars).

Every operator takes and returns DataFrames. Intermediate tables that are used twice are
written once to the folder named by ``spark.checkpoint.dir`` and read back, so that a lost
executor costs only its own tasks.
"""
