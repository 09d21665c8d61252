"""folioflow.streaming"""
