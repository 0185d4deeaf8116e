"""Operators for building training corpora.

Each module holds one operator as ``DataFrame -> DataFrame`` functions;
``queries`` binds them to the tables of a data folder and ``oracle`` holds the
DuckDB SQL twins.  Nothing outside this subpackage imports it.
"""
