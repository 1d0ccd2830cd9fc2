"""Operators over the columns of a table: profiling, hints, layout choice, codecs and the codec advisor."""
