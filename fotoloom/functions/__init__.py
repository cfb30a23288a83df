"""Scalar functions: columns in, columns out, inside whole-stage codegen where Spark can."""
