"""stresslens.functions"""
