"""Operators for preparing training corpora.

Every operator takes a DataFrame of documents (an integer id column and a text
column, names are parameters) and works on whole tables and whole texts.
Conventions shared by all of them, unless a docstring says otherwise:

* a null text counts as an empty text;
* a row whose id is null cannot be named in a report, so reports leave it out,
  and functions that return documents pass it through untouched;
* columns that the operator does not need are never read by it, so extra
  columns, whatever their names, cannot clash with its own.
"""
