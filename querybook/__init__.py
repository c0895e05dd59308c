"""Registered queries on the testbed tables, and the SQL each must agree with."""
