"""folioflow.sources"""
