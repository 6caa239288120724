"""stresslens.streaming"""
