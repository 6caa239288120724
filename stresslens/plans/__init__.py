"""stresslens.plans"""
