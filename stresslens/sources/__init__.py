"""stresslens.sources"""
