"""stresslens.operators"""
