"""folioflow.operators"""
