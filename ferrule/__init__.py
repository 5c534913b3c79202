"""ferrule: a PySpark-native analytics engine for C source trees.

Fact extraction is a table function over file rows, the code graph is a set of
plain fact tables, and every query over it is a DataFrame plan.
"""
